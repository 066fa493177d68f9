"""Bounded chart frames: what a plot of millions of rows needs, no more.

*Lines* keep the shape: the x range of a series is cut into equal buckets and of each only the first, last, lowest and
highest point stay, so every peak, dip and end of the whole line is in the result.  One pass finds the series' ranges,
one reduces them by a partially aggregated minimum and maximum of (y, x) and (x, y): a series however long is a few rows
per bucket before any shuffle.

*Points* keep a seeded sample: of each facet the rows with the smallest hash.  A row count per facet gives a threshold
that a little more than enough rows pass; those are grouped (so that repeated rows are one) and the smallest kept.  A
facet for which the threshold was too low, because of many repeated rows, is done again with a higher one, so the result
is the exact bottom-k, the same for any partitioning.  The only rows that meet in one task are the few that passed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablab.functions.hashing import HASH_RANGE, key_hash
from tablab.functions.kinds import is_numeric_type, require_columns, require_numeric
from tablab.functions.long import q
from tablab.functions.names import private
from tablab.session import ensure_checkpoint_dir

#: Points that a bucket of a line keeps at most.
PER_BUCKET = 4
#: A key with over one in so many rows is hot; there are fewer hot keys than this, whatever the table.
HOT_KEYS = 1000


def position(df: DataFrame, x: str) -> Column:
    """x as a double: numbers as they are, times as seconds, dates as days."""
    kind = df.schema[x].dataType
    if is_numeric_type(kind) or isinstance(kind, T.TimestampType):
        return q(x).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return q(x).cast("timestamp").cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(q(x)).cast("double")
    raise ValueError(f"column {x!r} is neither a number nor a time")


def _matched(rows: DataFrame, facts: DataFrame, keys: Sequence[str], weight: str | None = None) -> DataFrame:
    """``rows`` with the columns of ``facts`` (one row per key, null meeting null); the engine chooses by their size.
    ``weight``: the column of ``facts``, which then have all keys and are read more than once, with the number of ``rows``
    of each key.  The facts of hot keys are broadcast, so that a key with half of all rows stays where its rows are; other
    keys, none with over a thousandth of the rows, meet by shuffle."""
    if not keys:  # at most one row of facts
        row = facts.first()
        extra = [F.lit(None if row is None else row[f.name]).cast(f.dataType).alias(f.name) for f in facts.schema.fields]
        return rows.select("*", *extra) if row is not None else rows.select("*", *extra).where(F.lit(False))
    names = private([*rows.columns, *facts.columns], *[f"k{i}" for i in range(len(keys))])
    renamed = facts.select(*[q(c).alias(names[keys.index(c)]) if c in keys else q(c) for c in facts.columns])
    same = F.lit(True)
    for k, n in zip(keys, names):
        same = same & q(k).eqNullSafe(F.col(n))
    if weight is None:
        return rows.join(renamed, same).drop(*names)
    hot = F.col(weight) * HOT_KEYS > (facts.agg(F.sum(weight)).first()[0] or 0)
    heavy, light = F.broadcast(renamed.where(hot)), renamed.where(~hot)
    direct = rows.join(heavy, same).drop(*names)
    if light.isEmpty():
        return direct
    return direct.unionByName(rows.join(heavy, same, "left_anti").join(light, same).drop(*names))


def line_envelope(df: DataFrame, x: str, y: str, series: Sequence[str] = (), max_points: int = 2000) -> DataFrame:
    """Columns x, y and ``series`` of at most ``max_points`` rows for each series, in no order.  A series that fits is
    kept whole.  Of a longer one the points without x or y are left out, and of every bucket of x stay the first and last
    point (by x, then y) and the lowest and highest (by y, then x); ``max_points // 4`` buckets split its range evenly."""
    cols = list(dict.fromkeys([x, y, *series]))
    require_columns(df, cols)
    require_numeric(df, [y])
    if max_points < PER_BUCKET:
        raise ValueError(f"max_points must be at least {PER_BUCKET}")
    series = [s for s in dict.fromkeys(series) if s not in (x, y)]
    at, n, low, high, bucket, ends = private(cols, "at", "n", "low", "high", "bucket", "ends")
    rows = df.select(*[q(c) for c in cols]).withColumn(at, position(df, x))
    facts = rows.groupBy(*[q(s) for s in series]).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(low), F.max(at).alias(high))
    ensure_checkpoint_dir(df.sparkSession)
    rows = _matched(rows, facts.checkpoint() if series else facts, series, n)
    buckets = max_points // PER_BUCKET
    share = F.try_divide(F.col(at) - F.col(low), F.col(high) - F.col(low))
    place = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * F.lit(float(buckets))), F.lit(buckets - 1))
    whole = rows.where(F.col(n) <= max_points).select(*[q(c) for c in cols])
    long = rows.where((F.col(n) > max_points) & F.col(at).isNotNull() & q(y).isNotNull()).withColumn(bucket, place)
    by_y, by_x = F.struct(q(y).alias("y"), q(x).alias("x")), F.struct(q(x).alias("x"), q(y).alias("y"))
    turned = lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))
    four = F.array_distinct(F.array(F.min(by_x), F.max(by_x), turned(F.min(by_y)), turned(F.max(by_y))))
    kept = long.groupBy(*[q(s) for s in series], q(bucket)).agg(four.alias(ends)).select(*[q(s) for s in series], F.explode(ends).alias(ends))
    out = {x: F.col(ends)["x"].alias(x), y: F.col(ends)["y"].alias(y), **{s: q(s) for s in series}}
    return whole.unionByName(kept.select(*[out[c] for c in cols]))


def sample_points(df: DataFrame, cols: Sequence[str], max_points: int, facets: Sequence[str] = (), key: Sequence[str] | None = None,
                  seed: int = 42) -> DataFrame:
    """Columns ``cols`` of the ``max_points`` rows with the smallest hash of (``key``, seed), for each value of ``facets``
    (null is one).  ``key`` identifies a row; by default all of ``cols`` do, and equal rows then stand or fall together
    but for the last, of which as many as fit are kept."""
    cols, facets = list(dict.fromkeys(cols)), list(dict.fromkeys(facets))
    key = cols if key is None else list(key)
    require_columns(df, [*cols, *facets, *key])
    if max_points < 1:
        raise ValueError("max_points must be at least 1")
    carried = list(dict.fromkeys([*cols, *facets, *key]))
    h, n, most, m, end, size = private(carried, "hash", "n", "most", "m", "end", "size")
    rows = df.select(*[q(c) for c in carried]).withColumn(h, key_hash(key, seed))
    sizes = df.groupBy(*[q(f) for f in facets]).agg(F.count(F.lit(1)).alias(size))
    # a little more than enough, by the spread of a binomial count
    wanted = max_points + 6 * math.sqrt(max_points) + 20
    limit = F.when(F.col(size) > wanted, F.ceil(F.lit(wanted * HASH_RANGE) / F.col(size))).otherwise(HASH_RANGE)
    ensure_checkpoint_dir(df.sparkSession)
    limits = sizes.select(*[q(f) for f in facets], F.col(size), limit.alias(most)).checkpoint()
    done: DataFrame | None = None
    while True:
        passed = _matched(rows, limits, facets, size).where(F.col(h) < F.col(most))
        groups = passed.groupBy(*[q(c) for c in carried], F.col(h), F.col(most)).agg(F.count(F.lit(1)).alias(m))
        groups = groups.checkpoint()
        got = groups.groupBy(*[q(f) for f in facets], F.col(most)).agg(F.sum(m).alias(n)).checkpoint()
        fine = got.where((F.col(n) >= max_points) | (F.col(most) >= HASH_RANGE)).drop(n, most)
        ready = _matched(groups, fine.withColumn(n, F.lit(1)), facets)
        done = ready if done is None else done.unionByName(ready)
        # a facet none of whose rows passed has no group at all; one that is done stays, so that its rows are told from others
        tried = F.col(most).between(1, HASH_RANGE - 1)
        again = _absent(limits.where(tried), fine, facets)
        if again.isEmpty():
            break
        again = again.withColumn(most, F.least(F.col(most) * 4, F.lit(HASH_RANGE)))
        rest = _absent(limits, again, facets).withColumn(most, F.lit(0).cast(limits.schema[most].dataType))
        limits = again.unionByName(rest).checkpoint()
    order = Window.partitionBy(*([q(f) for f in facets] or [F.lit(0)])).orderBy(h, *[q(c) for c in carried])
    ranked = done.withColumn(end, F.sum(m).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    left = F.least(F.col(m), F.lit(max_points) - (F.col(end) - F.col(m)))
    return ranked.where(left > 0).withColumn(n, F.explode(F.array_repeat(F.lit(1), left.cast("int")))).select(*[q(c) for c in cols])


def _absent(rows: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` whose key is not in ``found``, null meeting null."""
    names = private([*rows.columns, *found.columns], *[f"k{i}" for i in range(len(keys))], "there")
    marks = found.select(*[q(k).alias(a) for k, a in zip(keys, names)], F.lit(1).alias(names[-1])).distinct()
    same = F.lit(True)
    for k, a in zip(keys, names):
        same = same & q(k).eqNullSafe(F.col(a))
    return rows.join(marks, same, "left_anti")
