"""Exact substring deduplication by level-wise doubling.

A window is ``window`` consecutive words of one document; it is repeated if its word sequence starts anywhere else too
(same document included).  Every word that a repeated window covers is removed.

Levels go up by doubling to ``window`` (35: 18, then 35).  A window can only be repeated if every shorter window inside it
is, so only windows that are repeated at one length are extended to twice that length, and the search ends where none
survives.

* *Lowest level*: of the short windows inside each full window, the one with the smallest hash stands for all (copies
  choose alike, wherever they are), so about one window in nine is shuffled instead of all.
* *Higher levels* look only at the windows of the next length that hold a survivor, in the texts that still have any.
* *Repeated* is decided by counting: each hash keeps the least and the greatest place where it starts, partially
  aggregated, so a passage that a third of all documents share is one row per task; the join that marks its places is
  an ordinary equi-join, which adaptive execution splits where one hash is hot.  No group is ever gathered.
* Equal texts are searched once: identical documents of at least a window's words are repeated throughout.
* At the last level hashes have 128 bits, so a false match is out of reach; below, a false match costs a candidate.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Defined results: a null text has no words; a text shorter than a window
loses nothing; repeated rows are copies of one another; null or repeated ids are no problem, since texts are told apart
by their content; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablab.llm.common import as_signed, materialise, ref, release, temp_name
from tablab.session import drop_scratch

#: The lowest level is the first half, quarter, ... of the window that is at most this long (half at least).
LOWEST = 24
BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def levels(window: int) -> list[int]:
    found = [window]
    while found[0] > LOWEST or len(found) == 1 < found[0]:
        found.insert(0, -(-found[0] // 2))
    return found


class WindowHashes:
    """Hashes of all windows of a word list, any length, from running sums of ``hash(word i) * base**i`` (mod 2**64)."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def powers(cls, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if which not in cls._powers or len(cls._powers[which][0]) < n:
            size = 1 << max(12, int(n).bit_length())
            made = []
            for base in (int(BASES[which]), pow(int(BASES[which]), -1, 1 << 64)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            if size > 1 << 18:  # not kept: the memory of one long text, not of the longest so far
                return made[0], made[1]
            cls._powers[which] = made[0], made[1]
        return cls._powers[which]

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.words = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, self.n)
        self.sums: dict[int, np.ndarray] = {}

    def of(self, length: int, which: int = 0) -> np.ndarray:
        """uint64 hash of every window of ``length`` words, by start."""
        if self.n < length:
            return np.empty(0, np.uint64)
        power, inverse = self.powers(which, self.n)
        if which not in self.sums:
            h = self.words if not which else (self.words ^ (self.words >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            self.sums[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[: self.n], dtype=np.uint64)])
        c = self.sums[which]
        out = (c[length:] - c[:-length]) * inverse[: self.n - length + 1]
        return out ^ (out >> np.uint64(32))


def representatives(hashes: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows with the smallest hash (leftmost of equals) among each ``width`` neighbours."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    near = np.lib.stride_tricks.sliding_window_view(hashes, width).argmin(axis=1)
    return np.unique(near + np.arange(len(near)))


def extended(starts: np.ndarray, short: int, long: int, n: int) -> np.ndarray:
    """Starts of the windows of ``long`` words, of ``n``, that hold one of the repeated windows of ``short`` words.  A
    repeated long window holds one: its representative at the lowest level, and what grew from that."""
    last = n - long + 1
    if last <= 0:
        return np.empty(0, np.int64)
    edge = np.zeros(n + 2, np.int64)
    np.add.at(edge, np.maximum(starts - (long - short), 0), 1)
    np.add.at(edge, starts + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[:last] > 0)


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _repeated(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (keys, text and start) whose keys start at two places at least, and the table of these keys.  It is written
    first: the counting shuffle is over before the other begins, and the join's sides are plain shuffles that can be split."""
    place = F.xxhash64(rows.columns[-2], "start")
    seen = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    seen = materialise(seen.select(*keys), "repeated")
    release(rows.sparkSession)
    return rows.join(seen, keys, "left_semi"), seen


def _lowest(texts: DataFrame, window: int, length: int) -> DataFrame:
    """(key, n_words, starts, hashes) of the representatives of every text long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, total, starts, hashes = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) < window:
                    continue
                all_hashes = WindowHashes(words).of(length)
                at = representatives(all_hashes, window - length + 1)
                keep.append(i)
                total.append(len(words))
                starts.append(at)
                hashes.append(as_signed(all_hashes[at]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(keep, pa.int32())), pa.array(total, pa.int64()), pa.array(starts, pa.list_(pa.int64())),
                 pa.array(hashes, pa.list_(pa.int64()))],
                names=["key", "n_words", "starts", "hashes"],
            )

    return texts.mapInArrow(run, "key binary, n_words long, starts array<bigint>, hashes array<bigint>")


def _windows(texts: DataFrame, short: int, long: int) -> DataFrame:
    """(g1, g2, uid, start) of every candidate window of ``long`` words; ``texts``: uid, text, starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column(0).to_pylist()
            found: list[tuple[np.ndarray, ...]] = []
            held = 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                hashes = WindowHashes(text.encode("utf-8", "surrogatepass").split())
                starts = np.asarray(batch.column(2)[i].values, np.int64)
                at = extended(starts, short, long, hashes.n)
                if len(at):
                    found.append((as_signed(hashes.of(long, 0)[at]), as_signed(hashes.of(long, 1)[at]), np.full(len(at), uids[i]), at))
                    held += len(at)
                if held > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["g1", "g2", "uid", "start"])
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], names=["g1", "g2", "uid", "start"])

    return texts.select("uid", "text", "starts").mapInArrow(run, "g1 long, g2 long, uid long, start long")


def _without(texts: DataFrame, window: int) -> DataFrame:
    """(key, n_words, n_removed, kept, spans) of texts with their repeated window starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept, spans = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.asarray(batch.column(2)[i].values, np.int64)
                edge[starts] += 1
                edge[starts + window] -= 1
                cover = np.cumsum(edge[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8)))
                total.append(len(words))
                gone.append(int(cover.sum()))
                kept.append(b" ".join([words[j] for j in np.flatnonzero(~cover).tolist()]).decode("utf-8", "surrogatepass"))
                spans.append([{"start": a, "end": b} for a, b in turns.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["key", "n_words", "n_removed", "kept", "spans"],
            )

    return texts.select("key", "text", "starts").mapInArrow(
        run, "key binary, n_words long, n_removed long, kept string, spans array<struct<start:bigint,end:bigint>>"
    )


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """One row per distinct text that loses words: key (MD5 of the text), n_words, n_removed, kept (the words left,
    joined by one blank) and spans (removed word ranges, end exclusive).  Materialised; the tables on the way there are
    deleted as soon as the next is written."""
    if window < 1:
        raise ValueError("a window has at least one word")
    spark, steps = docs.sparkSession, levels(window)
    rows = docs.select(ref(id_col).alias("id"), F.coalesce(ref(text_col), F.lit("")).alias("text"), text_key(ref(text_col)).alias("key"))
    low = materialise(_lowest(rows.select("key", "text"), window, steps[0]), "lowest")
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    copies = materialise(copies, "copies")  # one text of each key is searched
    pairs = low.select("key", F.explode(F.arrays_zip("starts", "hashes")).alias("w")).select(
        F.col("w.hashes").alias("hash"), "key", F.col("w.starts").alias("start")
    )
    alive, seen = _repeated(pairs, ["hash"])
    alive = alive.groupBy("key").agg(F.collect_set("start").alias("starts"))
    # the texts that still matter, one of each, under a short number that is fixed by being written
    alive = materialise(alive.join(copies, "key").withColumnRenamed("key", "alive_key"), "alive")
    drop_scratch(seen)
    release(spark)
    texts = rows.join(alive, (rows["key"] == alive["alive_key"]) & rows["id"].eqNullSafe(alive["least"]))
    texts = texts.select(F.monotonically_increasing_id().alias("uid"), "key", "text", "starts", "copies")
    texts = materialise(texts, "texts")
    drop_scratch(alive)
    release(spark)
    used = [low, copies, texts]  # until the result is written
    for short, long in zip(steps, steps[1:]):
        windows = _windows(texts, short, long)  # hashed twice from the texts rather than kept: they outweigh them
        places, seen = _repeated(windows, ["g1", "g2"])
        places = materialise(places.select("uid", "start"), "places")
        drop_scratch(seen)
        release(spark)
        used.append(places)
        starts = places.groupBy("uid").agg(F.collect_set("start").alias("starts"))  # at most one a word of a text
        texts = texts.drop("starts").join(starts, "uid")
        if long != window:
            texts = materialise(texts, "texts")
            drop_scratch(*used[2:])
            used[2:] = [texts]
    parted = _without(texts, window)
    # a text that occurs twice is repeated from its first word to its last
    whole = low.select("key", "n_words").distinct().join(copies.where("copies > 1"), "key", "left_semi")
    span = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    gone = whole.select("key", "n_words", F.col("n_words").alias("n_removed"), F.lit("").alias("kept"), span.alias("spans"))
    spans = materialise(parted.join(whole, "key", "left_anti").unionByName(gone), "spans")
    drop_scratch(*used)
    release(spark)
    return spans


def words_of(text: Column) -> Column:
    """Array of words by SQL functions."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """``docs`` with the words of repeated windows gone: a text that loses any becomes its remaining words joined by one
    blank, the others stay as they are."""
    key, kept = temp_name(docs, "key"), temp_name(docs, "kept")
    spans = repeated_spans(docs, id_col, text_col, window).select(F.col("key").alias(key), F.col("kept").alias(kept))
    joined = docs.withColumn(key, text_key(ref(text_col))).join(spans, key, "left")
    text = F.coalesce(ref(kept), ref(text_col)).alias(text_col)
    return joined.select(*[text if c == text_col else ref(c) for c in docs.columns])
