"""Best-fit packing of token pieces into sequences of a fixed capacity, bulk-synchronously.

Best fit takes pieces from long to short and puts each into the sequence whose gap is the smallest that still holds it
(opening a sequence if none does).  Lengths are whole numbers up to the capacity, so the two range-sorted lists the
method works on -- pieces by length, gaps by size -- are kept as *runs* of equal values: (length, number of pieces) and
(gap, first sequence, number of sequences).  However large the corpus, a list has at most ``capacity`` distinct values.

* *Range sort*: Spark counts the pieces of every length and gives each its rank among the equal ones (ranks inside
  salted groups plus the groups' offsets, so a length that half of all pieces share is ranked by many tasks).
* *Successor sweep, conflicts by rank, update, repeat*: a sweep looks up the successor run of gaps for the longest run
  of pieces left; piece ``r`` of the run takes sequence ``r`` of the gaps, so equal claims are settled by rank; the used
  gaps shrink and form a run at their new place; sweeps repeat until no piece is left.  The result is that of best-fit
  decreasing piece by piece.  One sweep handles runs of any count, and only runs and counts (bounded by the capacity,
  not by the corpus) are held by the driver.
* *Matching*: the sweeps' outcome is a table of runs (length, first rank, count, first sequence, offset).  Each task
  looks its pieces up in it by (length, rank); pieces never meet in one place.

Defined results: a null text is empty, and a document without ids is one piece holding the separator; repeated rows are
packed each on its own; a null id is packed like any other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablab.functions.small import collect_bounded
from tablab.llm.bpe import Encoder, Vocabulary
from tablab.llm.common import materialise, ref

#: How byte-level BPE files of this kind cut a text before merging (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a block of white space that sends a text past the library, whose expressions put every character of a run
#: on a stack of a million entries; every run of twice as many characters holds such a block.
BLANK = 50_000
#: Columns of the plan of sweeps.
PLAN = ("length", "rank", "count", "sequence", "offset")


def pack_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over runs.  ``counts``: pieces per length.  Returns rows of ``PLAN``, sorted by length and
    rank: piece ``rank + i`` (``i < count``) of a length goes to sequence ``sequence + i`` at ``offset``."""
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, count)
    sizes: list[int] = []  # the gaps there are, ascending
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def give(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, count))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens does not fit {capacity}")
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)  # the successor: the smallest gap that holds the length
            if at < len(sizes):
                gap = sizes[at]
                first, there = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], sizes[at]
            else:
                gap, first, there = capacity, opened, -(-left // (capacity // length))
                opened += there
            # piece by piece, a sequence stays the best fit until it can take no more of this length
            each = gap // length
            full = min(there, left // each)
            for slot in range(each):
                if full:
                    plan.append((length, rank, full, first, capacity - gap + slot * length))
                    rank += full
            give(gap - each * length, first, full)
            left -= full * each
            rest = there - full
            if left and rest:  # fewer pieces than one more sequence could take
                for slot in range(left):
                    plan.append((length, rank, 1, first + full, capacity - gap + slot * length))
                    rank += 1
                give(gap - left * length, first + full, 1)
                rest, left = rest - 1, 0
                give(gap, first + full + 1, rest)
            else:
                give(gap, first + full, rest)
    return np.array(sorted(plan), np.int64).reshape(-1, len(PLAN))


_ENCODERS: dict[int, Callable[[str | None], bytes]] = {}


def long_blank(text: str) -> bool:
    """Whether an aligned block of ``BLANK`` characters is all white space."""
    return any(text[at : at + BLANK].isspace() for at in range(0, len(text) - BLANK + 1, BLANK))


def library_encoder(content: bytes) -> Callable[[str | None], bytes]:
    """Text -> ids as little-endian uint32 bytes, by a tokenizer library on the given vocabulary file (packing is about
    lengths; the transducer of ``bpe`` gives the same ids).  The library merges by id, so ids must follow the merges.
    Texts with a very long run of white space, which the library cannot cut, go through ``bpe.Encoder``."""
    key = hash(content)
    if key not in _ENCODERS:
        v = Vocabulary(content)
        if any(made != v.made.min() + rank for rank, made in enumerate(v.made.tolist())):
            raise ValueError("the ids of the vocabulary do not follow its merges")
        ranks = {b: i for i, b in v.bytes_of.items() if i not in set(v.special.values())}
        library = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=v.special)
        own = Encoder(v)

        def encode(text: str | None) -> bytes:
            if text and long_blank(text):
                return own.encode(text).tobytes()
            return library.encode_to_numpy(text or "", allowed_special="all").astype("<u4", copy=False).tobytes()

        _ENCODERS[key] = encode
    return _ENCODERS[key]


def cut_pieces(docs: DataFrame, content: bytes, capacity: int, separator: int, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document's ids and separator, cut from the end into pieces of
    ``capacity`` tokens; the first piece may be shorter."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(content)
    end = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(vocabulary.value)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py()) + end
                n = len(ids) // 4
                at, k = 0, 0
                stop = n % capacity or capacity
                while at < n:
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(stop - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * stop]))
                    at, stop, k = stop, stop + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (piece, start, length, crc))],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece long, start long, length long, ids_crc32 long")


def assign(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (materialised, with a column ``length``) plus ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*pieces.columns), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    groups = materialise(groups, "groups")
    counts = collect_bounded(groups.groupBy("length").agg(F.sum("n").alias("n")), capacity, "piece lengths")
    plan = spark.sparkContext.broadcast(pack_runs({r["length"]: r["n"] for r in counts}, capacity))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("length", "salt").orderBy(*[c for c in pieces.columns if c != "length"])
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(offsets, ["length", "salt"])
    ranked = ranked.select(*pieces.columns, (F.col("rank") + F.col("earlier")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, sequence, offset = plan.value.T
        key = length << 44 | rank
        for batch in batches:
            mine = batch.column("rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, batch.column("length").to_numpy(zero_copy_only=False) << 44 | mine, side="right") - 1
            placed = [pa.array(sequence[at] + mine - rank[at]), pa.array(offset[at])]
            keep = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *placed], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, content: bytes, capacity: int = 1024, separator: int = 2, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = materialise(cut_pieces(docs, content, capacity, separator, id_col, text_col), "pieces")
    return assign(pieces, capacity).withColumnRenamed("id", id_col)
