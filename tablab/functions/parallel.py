"""Parallelism helper for callers with small inputs.

A large table arrives in many files and is left as it is.  A table in fewer
files than the session has task slots (one-row-group test files) would run a
CPU-heavy operator on a few cores; its caller may deal it out first.  Operators
never do that themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the default parallelism if its source has fewer files
    than that (a look at the file list; no job)."""
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if 0 < len(df.inputFiles()) < target else df
