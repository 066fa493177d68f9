"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``r`` bits have a common point within ``ceil(r/2)`` bits of one and ``floor(r/2)`` bits of the
other.  So every distinct fingerprint emits all variants within half the radius, the variants are shuffled, and only
fingerprints that meet on a variant are compared.

* Copies collapse first: the candidate search sees each distinct fingerprint once, so a group of copies costs one row
  whatever its size.
* Even radius: all fingerprints that meet on a variant are within ``r/2`` of it, hence within ``r`` of one another, so
  linking each to the smallest of them loses no component and emits no pairs.  A variant can be met by at most the
  ball's volume of distinct fingerprints (65 at radius 2), a bound that data cannot exceed.
* Odd radius: the smaller and the larger ball meet, and pairs are formed between the two kinds only (both bounded by
  their ball's volume).
* Every colliding pair is deduplicated and its distance verified before it becomes a link.

Results for odd inputs: a null or wordless text has the fingerprint 0 and links like any other; a text with fewer words
than a shingle is one shingle of all its words; repeated rows give repeated rows; a null id takes part in linking but is
never a component's name (a component of null ids only has a null name); unrelated components whose smallest id is the
same repeated id have the same name, but ``drop_near_duplicates`` keeps a row of each; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablab.llm.common import as_signed, materialise, ref, temp_name
from tablab.llm.components import connected_components

#: Rows of hashes unpacked to bits at a time; bounds memory for texts of any length.
BLOCK = 1 << 14


def shingle_hashes(text: str | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``size``-word shingle, repeats included; of the whole sequence if it is shorter."""
    if text is None:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    spans = map(slice, starts, (ends[size - 1 :] - 1).tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(seed)), np.uint64, len(words) - size + 1)


def simhash(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = hashes[i : i + BLOCK].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (ones * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


#: Variants that one task emits, about.
TASK_ROWS = 500_000


def fingerprint_udf(shingle: int = 3, seed: int = 42):
    """Arrow-batched column function text -> fingerprint (its 64 bits as a long)."""

    @F.pandas_udf("long")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            prints = np.fromiter((simhash(shingle_hashes(t, shingle, seed)) for t in batch), np.uint64, len(batch))
            yield pd.Series(as_signed(prints))

    return fingerprint


def ball_masks(radius: int) -> list[int]:
    """All 64-bit masks with at most ``radius`` bits set, as signed longs."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _variants(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, variant): every point within ``radius`` bits of every fingerprint."""
    if radius == 0:
        return prints.select("fp", F.col("fp").alias("variant"))
    if radius == 1:  # from an expression; larger balls from a table of masks of fixed size
        flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
        return prints.select("fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), flips)).alias("m")).select(
            "fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant")
        )
    masks = F.from_json(F.lit(str(ball_masks(radius))), "array<bigint>")
    return prints.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))


def near_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """Verified links (a, b), a < b, between distinct fingerprints (column ``fp``) whose components are those of all
    pairs within ``radius`` bits."""
    if not 0 <= radius <= 6:
        raise ValueError("radius must be 0 to 6 bits")
    prints = prints.select("fp").where("fp is not null").distinct()
    # a small table that grows by the size of the ball: tasks are counted from what they will emit
    emitted = prints.count() * len(ball_masks((radius + 1) // 2))
    prints = prints.repartition(max(1, emitted // TASK_ROWS), "fp")
    if radius % 2 == 0:
        met = _variants(prints, radius // 2).withColumn("low", F.min("fp").over(Window.partitionBy("variant")))
        found = met.where("low <> fp").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    else:
        small = _variants(prints, radius // 2).withColumnRenamed("fp", "x")
        large = _variants(prints, radius // 2 + 1).withColumnRenamed("fp", "y")
        found = small.join(large, "variant").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return found.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def components_of(rows: DataFrame, id_col: str, radius: int) -> DataFrame:
    """(fp, component, component_id, least_id) per distinct fingerprint of ``rows`` (columns ``id_col`` and ``fp``,
    materialised): the component's own key (a fingerprint of it), the smallest id reachable over links of at most
    ``radius`` differing bits, and the smallest id of the fingerprint itself.  Where ids repeat on different texts,
    several components can have the same smallest id; their keys differ."""
    prints = materialise(rows.groupBy("fp").agg(F.min(ref(id_col)).alias("least_id")), "prints")
    linked = connected_components(near_pairs(prints, radius), "a", "b")
    named = prints.join(linked, prints["fp"] == linked["node"], "left").select(
        prints["fp"], "least_id", F.coalesce("component", prints["fp"]).alias("component")
    )
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return named.join(least, "component").select("fp", "component", "component_id", "least_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       max_bits: int = 2, seed: int = 42) -> DataFrame:
    """One row per input row: id, fp (long) and component_id."""
    rows = docs.select(ref(id_col).alias(id_col), fingerprint_udf(shingle, seed)(ref(text_col)).alias("fp"))
    rows = materialise(rows, "fingerprints")
    found = components_of(rows, id_col, max_bits).select("fp", "component_id")
    return rows.join(found, "fp").select(ref(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_bits: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id (nulls last), of several the one with the
    smallest fingerprint, of several the one with the smallest text hash.  Components are told apart by their links, not
    by ids: an id that repeats on unrelated texts can head each of their components."""
    fp, rank = temp_name(docs, "fp"), temp_name(docs, "rank")
    marked = materialise(docs.withColumn(fp, fingerprint_udf(shingle, seed)(ref(text_col))), "marked")
    found = components_of(marked.select(ref(id_col).alias("id"), ref(fp).alias("fp")), "id", max_bits)
    firsts = found.where(F.col("least_id").eqNullSafe(F.col("component_id")))  # the fingerprints that hold the smallest id
    heads = firsts.groupBy("component", F.col("component_id").alias("head")).agg(F.min("fp").alias("head_fp")).drop("component")
    zero = F.lit("" if marked.schema[id_col].dataType.simpleString() == "string" else 0).cast(marked.schema[id_col].dataType)
    kept = marked.join(heads, ref(id_col).eqNullSafe(F.col("head")) & (ref(fp) == F.col("head_fp")), "left_semi")
    # the join's own partitioning expressions, so that the texts are shuffled once
    parts = [F.coalesce(ref(id_col), zero), F.isnull(ref(id_col)), ref(fp)]
    one = Window.partitionBy(*parts).orderBy(F.xxhash64(ref(text_col)), ref(text_col))
    return kept.withColumn(rank, F.row_number().over(one)).where(ref(rank) == 1).drop(fp, rank)
