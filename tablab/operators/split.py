"""Train/test split and K-fold assignment (M2, M13 folds).

All assignments come from a hash of the row key and the seed, so they do not
depend on partitioning, task order or retries, and are reproducible in SQL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablab.functions.hashing import HASH_RANGE, key_hash
from tablab.functions.kinds import require_columns
from tablab.functions.long import q
from tablab.functions.names import private

SPLIT_RESOLUTION = 10_000
# Sub-ranges of the hash, per shuffle partition, used to rank rows within a
# class without sorting a whole class in one task (a class may hold a third of
# all rows).  The ranks do not depend on their number.
STRATA_SUBRANGES = 16


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def with_test_flag(df: DataFrame, key: str | Sequence[str], test_size: float = 0.2, seed: int = 42,
                   col: str = "is_test") -> DataFrame:
    """Add a boolean ``is_test``: hash(key, seed) % 10000 < test_size * 10000."""
    keys = _keys(key)
    require_columns(df, keys)
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    cut = int(round(test_size * SPLIT_RESOLUTION))
    return df.withColumn(col, (key_hash(keys, seed) % SPLIT_RESOLUTION) < cut)


def with_exact_test_flag(df: DataFrame, key: str | Sequence[str], test_size: float = 0.2, seed: int = 42,
                         col: str = "is_test") -> DataFrame:
    """Add a boolean ``is_test`` that holds for exactly ceil(n * test_size)
    rows: those with the smallest (hash, key), ranked like folds are."""
    keys = _keys(key)
    require_columns(df, keys)
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    whole, rank = private([*df.columns, col], "all", "rank")
    ranked = _ranked(df.withColumn(whole, F.lit(0)), keys, whole, seed, rank)
    n_test = math.ceil(round(df.count() * test_size, 9))
    return ranked.withColumn(col, F.col(rank) < n_test).drop(whole, rank)


def train_test_split(df: DataFrame, key: str | Sequence[str], test_size: float = 0.2, seed: int = 42,
                     exact: bool = False):
    """(train, test) DataFrames; unstratified, deterministic per key.  With
    ``exact`` the test side has exactly ceil(n * test_size) rows."""
    (flag,) = private(df.columns, "is_test")
    flagged = (with_exact_test_flag if exact else with_test_flag)(df, key, test_size, seed, flag)
    return flagged.where(~F.col(flag)).drop(flag), flagged.where(F.col(flag)).drop(flag)


def kfold(df: DataFrame, key: str | Sequence[str], k: int = 5, seed: int = 42, col: str = "fold") -> DataFrame:
    """Add ``fold`` = hash(key, seed) % k."""
    keys = _keys(key)
    require_columns(df, keys)
    if k < 2:
        raise ValueError("k must be >= 2")
    return df.withColumn(col, (key_hash(keys, seed) % k).cast("int"))


def _ranked(df: DataFrame, keys: list[str], label: str, seed: int, rank: str) -> DataFrame:
    """Add ``rank``: place of the row among the rows of its class (a null
    label is a class), by (hash, key).  The hash range is cut into sub-ranges,
    their counts give each sub-range's offset, and rows are ranked inside their
    sub-range only."""
    h, sub, n, cl, cs, off, rn = private([*df.columns, rank], "h", "sub", "n", "cl", "cs", "off", "rn")
    ranges = STRATA_SUBRANGES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = df.withColumn(h, key_hash(keys, seed)).withColumn(sub, (F.col(h) * ranges / HASH_RANGE).cast("int"))
    counts = hashed.groupBy(q(label), sub).agg(F.count(F.lit(1)).alias(n))
    offset = F.sum(n).over(Window.partitionBy(q(label)).orderBy(sub)) - F.col(n)
    counts = counts.select(q(label).alias(cl), F.col(sub).alias(cs), offset.alias(off))
    w = Window.partitionBy(q(label), sub).orderBy(h, *[q(k) for k in keys])
    ranked = hashed.withColumn(rn, F.row_number().over(w) - 1)
    out = ranked.join(counts, q(label).eqNullSafe(F.col(cl)) & (F.col(sub) == F.col(cs)))
    return out.withColumn(rank, F.col(off) + F.col(rn)).drop(h, sub, rn, off, cl, cs)


def stratified_kfold(df: DataFrame, key: str | Sequence[str], label: str, k: int = 5, seed: int = 42,
                     col: str = "fold") -> DataFrame:
    """Add ``fold`` so that each class (null labels are one) is spread evenly
    over the folds: rows of a class are ranked by (hash, key) and dealt
    round-robin (rank % k)."""
    keys = _keys(key)
    require_columns(df, keys + [label])
    if k < 2:
        raise ValueError("k must be >= 2")
    (rank,) = private([*df.columns, col], "rank")
    return _ranked(df, keys, label, seed, rank).withColumn(col, (F.col(rank) % k).cast("int")).drop(rank)
