"""Parquet scan with the missing-value rule applied at the boundary.

pandas treats NaN as missing; Spark does not.  Every table entering the
library therefore has NaN turned into NULL on its float columns (``nanvl``,
a codegen'd projection that does not block filter pushdown or pruning).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in float/double columns; other columns untouched."""
    if not any(isinstance(f.dataType, (T.FloatType, T.DoubleType)) for f in df.schema.fields):
        return df
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            cols.append(F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(c)
    return df.select(*cols)


def read_table(spark: SparkSession, path: str, normalize_missing: bool = True) -> DataFrame:
    df = spark.read.parquet(path)
    return nan_to_null(df) if normalize_missing else df


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables, e.g. ``load(spark, '/root/testdata/sf0.01', 'lineitem')``."""
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Where a row stands: (file, index in the file), in the order of file names.
POSITION = "position"


def read_positioned(spark: SparkSession, path: str, normalize_missing: bool = True) -> DataFrame:
    """A Parquet table with the column ``position``, from the files' own metadata: the same for a row however the scan is
    split, so "first" means the same on every cluster.  A column of the table with that name is an error."""
    df = spark.read.parquet(path)
    if POSITION in {c.lower() for c in df.columns}:
        raise ValueError(f"the table has a column {POSITION!r}")
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = df.select("*", place.alias(POSITION))
    return nan_to_null(rows) if normalize_missing else rows


def head(spark: SparkSession, path: str, n: int = 50) -> DataFrame:
    """The first n rows of a Parquet table by position.  No row beyond the n-th of its file is sorted."""
    return read_positioned(spark, path).where(F.col(POSITION)["row"] < n).orderBy(POSITION).limit(n).drop(POSITION)
