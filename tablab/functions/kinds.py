"""column kinds, decided from the schema alone (no job)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def is_integral_type(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns with a number type (booleans are not numbers)."""
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def categorical_columns(df: DataFrame, encodable: bool = False) -> list[str]:
    """Non-numeric columns; with ``encodable=True`` only string columns
    (the ones label / one-hot encoding accepts)."""
    if encodable:
        return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return [f.name for f in df.schema.fields if not is_numeric_type(f.dataType)]


def column_type(df: DataFrame, name: str) -> T.DataType:
    require_columns(df, [name])
    return df.schema[name].dataType


def require_columns(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column(s): {missing}; table has {df.columns}")


def require_numeric(df: DataFrame, cols) -> None:
    require_columns(df, cols)
    bad = [c for c in cols if not is_numeric_type(df.schema[c].dataType)]
    if bad:
        raise ValueError(f"column(s) {bad} are not numeric")
