"""Importance resampling of documents towards a target distribution, by hashed n-gram features.

Features are runs of 1 to ``max_words`` consecutive words, hashed into ``buckets`` buckets; a bucket's gain is the
floored log ratio of its smoothed share in the target to that in the corpus.  A document's *weight* is the sum of gains
over its features, its *score* the weight plus Gumbel noise from a hash of its id, so the highest scores are a sample
without replacement in proportion to the weights.

*Array-scored weights*: one pass turns every text into its array of bucket numbers (a written table); counts are sums of
``bincount`` arrays, one per task, and weights are sums of ``gains[buckets]``.  Only ``buckets`` numbers per side reach
the driver, whatever the corpus.

*Quantile-sketch bracketing*: the k-th highest score is not found by sorting all scores.  A sketch of bounded size gives a
bracket around it; exact counts above and inside it either confirm the bracket or widen it; only its rows are sorted to
locate the cutoff.  The drawn rows then get their ranks from a range-partitioned sort with one offset per partition.  Rows
carry numbers of their own, the last sort key, so no amount of equal scores or ids makes one partition hot.

Texts are read in blocks of about a megabyte of words, so a very long one needs no more memory than that besides itself.

Defined results: a null or empty text has no features: weight 0, never drawn unless ``min_words`` is 0; a null id is
hashed like an empty one and comes last among ties; rows that repeat an id are drawn each for itself (ties by number of
features, then by place); an empty corpus or target counts as all zeros; extra columns are ignored.
"""

from __future__ import annotations

from binascii import crc32
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablab.llm.common import materialise, ref

#: Bytes of text worked on at once, the size of a written piece of rows, and the sketch's accuracy (its rank error is
#: one part in so many of all rows).
BLOCK, ACCURACY = 1 << 20, 10000
#: ASCII letters in lower case; every other ASCII character but digits ends a word.
_TABLE = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 0x20 for c in range(256))


def word_blocks(text: str) -> Iterator[list[bytes]]:
    """Words of a text, in order, some megabyte of bytes at a time; a word is never cut."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            cut = data.rfind(b" ", at + 1, end)
            cut = data.find(b" ", end) if cut < 0 else cut
            end = len(data) if cut < 0 else cut
        yield data[at:end].split()
        at = end


def feature_buckets(text: str | None, buckets: int, max_words: int) -> tuple[int, np.ndarray]:
    """Number of words of a text, and the bucket of every feature."""
    out, n, carry = [np.zeros(0, np.int32)], 0, []
    for words in word_blocks(text or ""):
        n += len(words)
        out.append(np.array([crc32(w) for w in words], np.int64) % buckets)
        if max_words > 1:
            held = carry + words
            for k in range(2, max_words + 1):
                # runs that end in this block
                first = max(0, len(carry) - k + 1)
                out.append(np.array([crc32(b" ".join(held[i : i + k])) for i in range(first, len(held) - k + 1)], np.int64) % buckets)
            carry = held[-(max_words - 1):]
    return n, np.concatenate(out).astype(np.int32)


def featured(rows: DataFrame, text_col: str, buckets: int, max_words: int, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``rows``, n_words and the array of buckets."""
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), "n_words long", "buckets array<int>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            start = 0
            while start < len(batch):  # a piece ends once it holds a few megabytes
                size, found = 0, []
                for i in range(start, len(batch)):
                    found.append(feature_buckets(texts[i].as_py(), buckets, max_words))
                    size += len(found[-1][1])
                    if size > BLOCK:
                        break
                ends = np.cumsum([0, *(len(b) for _, b in found)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([b for _, b in found])))
                part = batch.slice(start, len(found))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([n for n, _ in found], pa.int64()), lists],
                                                 names=[*keep, "n_words", "buckets"])
                start += len(found)

    return rows.select(*[ref(c) for c in keep], ref(text_col)).mapInArrow(run, schema)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: one array per task, added up by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]  # at most ``buckets`` rows
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandfold log ratio of the smoothed shares, in doubles."""
    s, t, buckets = corpus.astype(np.float64), target.astype(np.float64), float(len(corpus))
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + buckets) / ((s + 1.0) * (t.sum() + buckets)))).astype(np.int64)


def weighed(features: DataFrame, gains: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep``, n_words, n_features and weight."""
    schema = ", ".join([*(f"`{c}` {features.schema[c].dataType.simpleString()}" for c in keep), "n_words long", "n_features long", "weight long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            counts = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(gains[lists.flatten().to_numpy(zero_copy_only=False)])])
            ends = np.cumsum(counts)
            weight = sums[ends] - sums[ends - counts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("n_words"), pa.array(counts), pa.array(weight)],
                                             names=[*keep, "n_words", "n_features", "weight"])

    return features.mapInArrow(run, schema)


def gumbel(id_column: Column, seed: int) -> Column:
    """Floored thousandfold Gumbel noise from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``rows`` (a written table) with their place, from 1, in a total order: sorted by ranges, numbered within each, and
    shifted by one offset per partition."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialise(placed.withColumn("__part", F.spark_partition_id()).withColumn("__within", within), "ranges")
    sizes = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())  # one per partition
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "__part int, __before long")
    joined = placed.join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__within") + 1).drop("__part", "__within", "__before")


def bracket(scores: DataFrame, k: int, n: int, accuracy: int = ACCURACY) -> tuple[float, float, int]:
    """(low, high, above): the k-th highest of the n scores lies in [low, high], and ``above`` scores exceed high.  The
    sketch proposes, exact counts decide; a bracket that misses is widened fourfold."""
    margin = 2.0 / accuracy
    while True:
        shares = [1.0 - k / n - margin, 1.0 - (k - 1) / n + margin]
        at = [min(1.0, max(0.0, p)) for p in shares]
        low, high = scores.agg(F.percentile_approx("score", at, accuracy).alias("q")).first()["q"]
        low, high = low if shares[0] > 0 else float("-inf"), high if shares[1] < 1 else float("inf")
        got = scores.agg(F.count(F.when(F.col("score") > high, 1)).alias("above"),
                         F.count(F.when(F.col("score").between(F.lit(low), F.lit(high)), 1)).alias("inside")).first()
        if got["above"] < k <= got["above"] + got["inside"]:
            return low, high, got["above"]
        margin *= 4


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", max_words: int = 1,
             buckets: int = 10000, percent: int = 10, min_words: int = 20, seed: int = 2024, accuracy: int = ACCURACY) -> DataFrame:
    """Every row of ``docs`` as (id column, n_words, n_features, weight, score, rank): the ``percent`` highest scores among
    the documents with at least ``min_words`` words have ranks 1, 2, 3 ..., the others null."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), ref(id_col).alias("id"), ref(text_col).cast("string").alias("text"))
    features = materialise(featured(rows, "text", buckets, max_words, ["row", "id"]), "features")
    aim = featured(target.select(ref(target_text).cast("string").alias("text"), F.lit(0).alias("row")), "text", buckets, max_words, ["row"])
    gains = bucket_gains(bucket_counts(features, buckets), bucket_counts(aim, buckets))
    scored = weighed(features, gains, ["row", "id"]).withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
    scored = materialise(scored, "scores")

    able = scored.where(F.col("n_words") >= min_words)
    n = able.count()
    k = percent * n // 100
    out = [F.col("id").alias(id_col), "n_words", "n_features", "weight", "score"]
    if not k:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    low, high, above = bracket(able, k, n, accuracy)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    inside = able.where(F.col("score").between(F.lit(low), F.lit(high))).select("score", "id", "n_features", "row")
    last = ranked(inside, order).where(F.col("rank") == k - above).first()
    # at or before the cutoff row in the same total order
    same = F.col("id").eqNullSafe(F.lit(last["id"]))
    sooner = F.coalesce(F.col("id") < F.lit(last["id"]), F.col("id").isNotNull() & F.lit(last["id"] is None))
    tail = (F.col("n_features") < last["n_features"]) | ((F.col("n_features") == last["n_features"]) & (F.col("row") <= last["row"]))
    drawn = (F.col("n_words") >= min_words) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (sooner | (same & tail))))
    return ranked(scored.where(drawn), order).select(*out, "rank").union(scored.where(~drawn).select(*out, F.lit(None).cast("long")))
