"""Labelled and unlabelled samples of documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablab.llm.common import ref

#: A document is held out of all training if the CRC-32 of its id's text leaves 0.
FOLDS = 5
_SHARE = 1 << 30


def held_out(id_column: Column) -> Column:
    """True for the held-out fifth; a null id is not held out (it has no label either)."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def hash_place(id_column: Column, salt: int = 7) -> Column:
    """Place of an id in the order by hash that samples are taken in."""
    return F.pmod(F.xxhash64(id_column, F.lit(salt)), F.lit(_SHARE))


def _below(id_column: Column, salt: int, share: float) -> Column:
    """A share of the ids, chosen by hash: the same rows on every run, whatever the partitions."""
    return hash_place(id_column, salt) < int(min(1.0, share) * _SHARE)


def training_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of the training rows, one per id; of repeated ids the smallest label counts, null labels do not."""
    rows = labels.select(ref(id_col).alias("id"), ref(label).cast("int").alias("y"))
    return rows.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y"))


def bounded_labels(train: DataFrame, most: dict[int, int], salt: int = 7) -> tuple[DataFrame, dict[int, int]]:
    """At most about ``most[y]`` training rows of each class, by hash of the id, and the full count of each class."""
    counts = {0: 0, 1: 0} | {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for y, bound in most.items():
        chosen = chosen | ((F.col("y") == y) & _below(F.col("id"), salt, bound / max(1, counts[y])))
    return train.where(chosen), counts  # ids are unique here, so the hash keeps the bound


def within_bound(rows: DataFrame, bound: int, salt: int = 13) -> DataFrame:
    """``rows`` (id, x, ...), or where repeated ids make them more than ``bound``, about so many, chosen by hash of id and
    inputs."""
    n = rows.count()
    return rows if n <= bound else rows.where(F.pmod(F.xxhash64("id", "x", F.lit(salt)), F.lit(_SHARE)) < bound * _SHARE // n)


def sample_by_hash(docs: DataFrame, bound: int, alias: str, salt: int = 11) -> Column:
    """Condition on the id column ``alias`` that holds for about ``bound`` rows of ``docs`` (all, if fewer)."""
    return _below(ref(alias), salt, bound / max(1, docs.count()))
