"""Exact quantiles (linear interpolation), mode and distinct counts by narrowing.

Spark's own ``percentile``/``median``/``mode`` aggregates keep a value->count
map per group and merge every partial map of a group in one task; for a
continuous column of a 100 TB table that map is the whole column.  Here a
wanted rank is bracketed and the bracket narrowed:

1. one pass: the row count and, from a bounded-memory sketch
   (``percentile_approx``, whose rank error is at most 1 / accuracy), two values
   that enclose each wanted rank;
2. one pass: rows below the bracket are only counted, rows above it are
   dropped, rows inside collapse to (value, count) before they are shuffled --
   about four rows in ``accuracy`` and repeated values;
3. the value at a rank is read off the running counts of the bracket.

No pass shuffles the values of a column.  For whole columns step 2 counts parts of
the bracket, by sorted batches, and repeats on the part that holds the rank until
few values are left; for groups it runs once, and the running counts are windows
over the brackets' values alone.  All results are exact.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablab.functions.long import q
from tablab.functions.names import private
from tablab.functions.small import collect_bounded, one_row

SKETCH_ACCURACY = 10000
#: Half width of a bracket as a share of the rows: twice the sketch's error.
MARGIN = 2.0 / SKETCH_ACCURACY
#: Parts of all brackets that a pass counts, values that the last pass reads in all, and the fewest per bracket.
PARTS, VALUES, FEW = 8192, 200_000, 64


#: Helper columns of :func:`quantiles_long`; its keys take other names on the way.
OWN = ("_v", "_n", "_min", "_max", "_e", "_pi", "_p", "_h", "_lo", "_hi", "_t", "_c", "_end", "_a", "_b", "q")


def _maybe_broadcast(df: DataFrame, bounded: bool) -> DataFrame:
    # Only frames whose row count is bounded by the schema (one row per column
    # name, times a fixed number of buckets/probabilities) are forced to
    # broadcast; per-group frames are left to AQE's runtime size check.
    return F.broadcast(df) if bounded else df


def value_counts_long(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., value, _c): distinct non-null values per key with multiplicity."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_c"))
    )


def quantiles_long(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    bounded_keys: bool = True,
) -> DataFrame:
    """Exact linear-interpolation quantiles of ``value`` per ``keys``.

    ``df`` has columns ``keys`` and ``value`` (numeric).  Returns
    ``(keys..., _pi, _p, q)`` where ``_pi`` indexes ``probs``.  Keys with no
    non-null value produce no rows; null keys are groups.  ``bounded_keys``
    says the number of distinct keys is bounded by the schema (e.g. a
    column-name key), which allows broadcasting the per-key frames; else the
    join is left to the runtime size check, and a hot key to its skew split.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("quantiles_long needs at least one key column")
    own = {k: n for k, n in zip(keys, private([*OWN, value], *[f"g{i}" for i in range(len(keys))]))}
    base = df.select(*[q(k).alias(n) for k, n in own.items()], q(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    given, keys = keys, list(own.values())
    ends = [x for p in probs for x in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    stats = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", ends, SKETCH_ACCURACY).alias("_e"),
    )
    targets = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        # the end ranks lie within two rows of the margin's; tiny groups are bracketed whole
        lo = F.when((F.col("_n") < SKETCH_ACCURACY) | F.lit(ends[2 * i] <= 0), F.col("_min")).otherwise(F.get("_e", F.lit(2 * i)))
        hi = F.when((F.col("_n") < SKETCH_ACCURACY) | F.lit(ends[2 * i + 1] >= 1), F.col("_max")).otherwise(F.get("_e", F.lit(2 * i + 1)))
        targets.append(F.struct(F.lit(i).alias("_pi"), F.lit(float(p)).alias("_p"), h.alias("_h"), lo.alias("_lo"), hi.alias("_hi")))
    names = [f"_key{i}" for i in range(len(keys))]
    stats = stats.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.array(*targets).alias("_t"))
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    rows = base.join(_maybe_broadcast(stats, bounded_keys), same)
    # per target: null stands for every value below the bracket, values above it are gone
    rows = rows.select(*keys, "_v", F.inline("_t")).where(F.col("_v") <= F.col("_hi"))
    group = [*keys, "_pi", "_p", "_h"]
    vc = rows.groupBy(*group, F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*group).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    vc = vc.withColumn("_end", F.sum("_c").over(order))
    at = lambda rank: F.max(F.when((rank >= F.col("_end") - F.col("_c")) & (rank < F.col("_end")), F.col("_v")))
    found = vc.groupBy(*group).agg(at(F.floor("_h")).alias("_a"), at(F.ceil("_h")).alias("_b"))
    return found.select(*[F.col(n).alias(k) for k, n in zip(given, keys)], "_pi", "_p", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.floor("_h"))).alias("q"))


def quantiles_wide(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    bounded_keys: bool = True,
) -> DataFrame:
    """Same as :func:`quantiles_long` with one output column per probability."""
    long = quantiles_long(df, keys, value, probs, bounded_keys=bounded_keys)
    aggs = [F.max(F.when(F.col("_pi") == i, F.col("q"))).alias(n) for i, n in enumerate(names)]
    return long.groupBy(*keys).agg(*aggs)


def mode_long(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., mode, freq): most frequent non-null value, ties -> smallest.

    One partial+final aggregate over the value counts: ``min_by`` with the
    ordering (-count, value) is associative, so no group is ever gathered.
    """
    vc = value_counts_long(df.select(*keys, value), keys, value)
    return vc.groupBy(*keys).agg(
        F.min_by(F.col(value), F.struct((-F.col("_c")).alias("nc"), F.col(value).alias("v"))).alias("mode"),
        F.max("_c").alias("freq"),
    )


def _ordered(v: float) -> int:
    """Whole number that orders as the double does."""
    bits = struct.unpack("<q", struct.pack("<d", v))[0]
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def _double(k: int) -> float:
    return struct.unpack("<d", struct.pack("<q", k))[0] if k >= 0 else -struct.unpack("<d", struct.pack("<q", -k))[0]


def _edges(low: float, high: float, parts: int) -> np.ndarray:
    """Ends of at most ``parts`` parts of [low, high] with equally many doubles each; the first is ``low`` alone, the
    last ``high``.  However the values lie, a part has at most a ``parts``-th of the doubles that the whole has."""
    a, b = _ordered(low), _ordered(high)
    steps = min(parts, b - a)
    return np.array([_double(a + (b - a) * i // steps) if steps else low for i in range(steps + 1)])


def _numbers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[q(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])


def _present(column: pa.Array) -> np.ndarray:
    v = column.to_numpy(zero_copy_only=False)
    return v[~np.isnan(v)]


def _part_counts(df: DataFrame, cols: Sequence[str], parts: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Per bracket k -> (column, edges): how many values lie below the first edge, in each part, in order.  One pass for
    all columns; a task sorts a batch of a column once and looks up all edges at a time."""
    by_column = [[k for k in parts if parts[k][0] == c] for c in range(len(cols))]
    looked = [np.concatenate([parts[k][1] for k in ks]) if ks else np.empty(0) for ks in by_column]
    firsts = [np.array([parts[k][1][0] for k in ks]) for ks in by_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {k: np.zeros(len(e) + 1, np.int64) for k, (_, e) in parts.items()}
        for batch in batches:
            for c, ks in enumerate(by_column):
                if ks:
                    v = np.sort(_present(batch.column(c)))
                    upto, below, at = np.searchsorted(v, looked[c], "right"), np.searchsorted(v, firsts[c], "left"), 0
                    for i, k in enumerate(ks):
                        n = len(parts[k][1])
                        total[k] += np.diff(upto[at : at + n], prepend=[0, below[i]])
                        at += n
        rows = [(k, np.flatnonzero(t)) for k, t in total.items()]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.full(len(at), k) for k, at in rows]), pa.int64()), pa.array(np.concatenate([at for _, at in rows]), pa.int64()),
            pa.array(np.concatenate([total[k][at] for k, at in rows]), pa.int64())], names=["k", "part", "n"])

    out = {k: np.zeros(len(e) + 1, np.int64) for k, (_, e) in parts.items()}
    sums = _numbers(df, cols).mapInArrow(run, "k long, part long, n long").groupBy("k", "part").agg(F.sum("n").alias("n"))
    for r in collect_bounded(sums, 2 * PARTS + 20 * len(parts), "counts around the wanted ranks"):
        out[r["k"]][r["part"]] = r["n"]
    return out


def _bracket_values(df: DataFrame, cols: Sequence[str], brackets: dict[int, tuple[int, float, float]]) -> dict[int, list[tuple[float, int]]]:
    """Per bracket k -> (column, low, high): its values with their counts, ascending."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
            columns = {}
            for k, (c, low, high) in brackets.items():
                v = columns.get(c)
                if v is None:
                    v = columns[c] = np.sort(_present(batch.column(c)))
                values, counts = np.unique(v[np.searchsorted(v, low, "left") : np.searchsorted(v, high, "right")], return_counts=True)
                got.append((np.full(len(values), k), values, counts))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got)], names=["k", "v", "n"])

    pairs = _numbers(df, cols).mapInArrow(run, "k long, v double, n long").groupBy("k", "v").agg(F.sum("n").alias("n"))
    out: dict[int, list[tuple[float, int]]] = {k: [] for k in brackets}
    for r in collect_bounded(pairs, VALUES + FEW * len(brackets), "values around the wanted ranks"):
        out[r["k"]].append((r["v"], r["n"]))
    return {k: sorted(v) for k, v in out.items()}


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of whole columns as constants: {column: [q per prob]} (None without a value; NaN is no value).

    A first pass brackets all wanted ranks by one sketch a column.  Each further pass counts, for all columns and brackets
    together, the values below and in the parts of every bracket, which confirms a bracket, or resets it to the whole
    range, and narrows it to the part that holds its rank; brackets with few values are read.  A task hands on one number
    per part, and the passes number at most 64 bits over the bits of a pass, whatever the values."""
    cols = list(dict.fromkeys(cols))
    x = {c: F.nanvl(q(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    ends = [e for p in probs for e in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    first = one_row(df.agg(*[
        F.struct(F.count(x[c]).alias("n"), F.min(x[c]).alias("min"), F.max(x[c]).alias("max"),
                 F.percentile_approx(x[c], ends or [0.5], SKETCH_ACCURACY).alias("e")).alias(f"c{i}")
        for i, c in enumerate(cols)
    ])) if cols else {}
    size = [first[f"c{i}"]["n"] for i in range(len(cols))]
    span = [(first[f"c{i}"]["min"], first[f"c{i}"]["max"]) for i in range(len(cols))]
    # wanted: (column, rank) -> bracket, both ends included; a small column is read whole
    wanted: dict[tuple[int, int], tuple[float, float]] = {}
    for i in range(len(cols)):
        for j, p in enumerate(probs if size[i] else []):
            e = first[f"c{i}"]["e"][2 * j : 2 * j + 2]
            low = span[i][0] if ends[2 * j] <= 0 or size[i] < SKETCH_ACCURACY else e[0]
            high = span[i][1] if ends[2 * j + 1] >= 1 or size[i] < SKETCH_ACCURACY else e[1]
            for r in {math.floor((size[i] - 1) * p), math.ceil((size[i] - 1) * p)}:
                wanted.setdefault((i, r), (low, high))
    value: dict[tuple[int, int], float] = {t: b[0] for t, b in wanted.items() if span[t[0]][0] == span[t[0]][1]}
    few = max(FEW, VALUES // max(1, len(wanted)))
    read: dict[tuple[int, int], tuple[float, float, int]] = {t: (*span[t[0]], 0) for t in wanted if t not in value and size[t[0]] <= few}
    todo = {t: b for t, b in wanted.items() if t not in value and t not in read}
    while todo:
        brackets = sorted({(c, *b) for (c, _), b in todo.items()})
        number = {b: k for k, b in enumerate(brackets)}
        parts = {k: (c, _edges(low, high, max(16, PARTS // len(brackets)))) for (c, low, high), k in number.items()}
        counts, later = _part_counts(df, cols, parts), {}
        for (c, r), b in todo.items():
            k = number[(c, *b)]
            upto = np.cumsum(counts[k])  # below the first edge, then up to each edge
            part = int(np.searchsorted(upto, r, "right"))
            if part == 0 or part == len(upto):  # the sketch promises otherwise; count rather than trust it
                later[c, r] = span[c]
                continue
            edges = parts[k][1]
            low, high = edges[0] if part == 1 else _double(_ordered(edges[part - 2]) + 1), edges[part - 1]
            if low == high:
                value[c, r] = float(high)
            elif counts[k][part] <= few:
                read[c, r] = (float(low), float(high), int(upto[part - 1]))
            else:
                later[c, r] = (float(low), float(high))
        todo = later
    if read:
        spans = sorted({(c, low, high) for (c, _), (low, high, _) in read.items()})
        found = _bracket_values(df, cols, dict(enumerate(spans)))
        for (c, r), (low, high, end) in read.items():
            for v, n in found[spans.index((c, low, high))]:
                end += n
                if r < end:
                    value[c, r] = v
                    break
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = []
        for p in probs:
            h = (size[i] - 1) * p
            a, b = (value[i, math.floor(h)], value[i, math.ceil(h)]) if size[i] else (None, None)
            out[c].append(None if a is None else a if a == b else a + (b - a) * (h - math.floor(h)))
    return out
