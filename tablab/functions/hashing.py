"""Deterministic per-row hashing for splits, folds and sampling.

The unit is the first 32 bits of ``md5(concat_ws('-', key..., seed))`` read
as an unsigned integer: it depends only on the row's key, never on the
partitioning, so a split is identical after a repartition, on a retry after
a lost executor, and in any engine with md5 (DuckDB:
``('0x' || substr(md5(...), 1, 8))::BIGINT``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

HASH_RANGE = 1 << 32


def key_hash(keys: Sequence[str], seed: int):
    """bigint in [0, 2^32) from the key columns and the seed."""
    parts = [F.col(f"`{k}`").cast("string") for k in keys] + [F.lit(str(seed))]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *parts)), 1, 8), 16, 10).cast("bigint")
