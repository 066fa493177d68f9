"""Cleaning operators.

Fill operators are fit/apply pairs: ``fit_*`` runs one aggregate and returns
JSON-serialisable constants; ``apply_*`` is a pure projection, so a fitted
step replays on any table with the same columns (see plans.recipe).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablab.functions.kinds import is_numeric_type, require_columns
from tablab.functions.long import q
from tablab.operators import profile as P


# ------------------------------------------------------------ F3 / F4 / F5
def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns; unknown names are an error (Spark would ignore them)."""
    require_columns(df, cols)
    return df.drop(*cols)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    """Rename one column; a name already taken by another column is rejected."""
    require_columns(df, [old])
    if new != old and new in df.columns:
        raise ValueError(f"column {new!r} already exists")
    return df.withColumnRenamed(old, new)


def drop_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of ``cols`` (all columns by default)."""
    if cols is not None:
        require_columns(df, cols)
    return df.na.drop(how="any", subset=list(cols) if cols is not None else None)


# ------------------------------------------------------------------- A9
def drop_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep one row per distinct row (nulls equal).  Planned as a hash
    aggregate with map-side partial aggregation, so a heavily duplicated row
    is collapsed before the shuffle."""
    if cols is None:
        return df.dropDuplicates()
    require_columns(df, cols)
    return df.dropDuplicates(list(cols))


def first_of_duplicates(df: DataFrame, cols: Sequence[str] | None = None, position: str = "position") -> DataFrame:
    """The first row, by the column ``position`` (:func:`tablab.sources.tables.read_positioned`), of all rows that are equal
    in ``cols`` (nulls equal; default: all other columns), in full and with its position.  One associative minimum of
    (position, row): a value that a third of all rows hold is a row a task before any shuffle."""
    cols = [c for c in df.columns if c != position] if cols is None else list(cols)
    require_columns(df, [*cols, position])
    own, first = [f"k{i}" for i in range(len(cols))], F.struct(q(position).alias("p"), F.struct(*[q(c) for c in df.columns]).alias("r"))
    rows = df.select(*[q(c).alias(n) for c, n in zip(cols, own)], first.alias("first"))
    kept = rows.groupBy(*own).agg(F.min_by("first", F.col("first")["p"]).alias("first"))
    return kept.select("first.r.*")


# ------------------------------------------------------------ C1-C4 fill
FILL_STRATEGIES = ("mean", "median", "mode", "value")


def fit_fill_nulls(df: DataFrame, c: str, strategy: str, value=None) -> dict:
    """Fill constant for column ``c``.

    mean/median: numeric columns only, the result column becomes double.
    mode: most frequent value, ties -> smallest; an all-null column is an
    error.  value: parsed as a float for numeric columns (unparseable text is
    an error), used as text otherwise.
    """
    require_columns(df, [c])
    dt = df.schema[c].dataType
    if strategy not in FILL_STRATEGIES:
        raise ValueError(f"strategy must be one of {FILL_STRATEGIES}")
    if strategy in ("mean", "median"):
        if not is_numeric_type(dt):
            raise ValueError(f"{strategy} fill needs a numeric column; {c!r} is {dt.simpleString()}")
        v = P.column_mean(df, c) if strategy == "mean" else P.column_median(df, c)
        return {"value": v, "type": "double"}
    if strategy == "mode":
        v = P.column_mode(df, c)
        if v is None:
            raise ValueError(f"column {c!r} has no non-null value to take the mode of")
        return {"value": v, "type": dt.simpleString()}
    if value is None:
        raise ValueError("strategy 'value' needs a value")
    if is_numeric_type(dt):
        try:
            return {"value": float(value), "type": "double"}
        except (TypeError, ValueError):
            raise ValueError(f"{value!r} is not a number, and column {c!r} is numeric") from None
    return {"value": str(value), "type": "string" if isinstance(dt, T.StringType) else dt.simpleString()}


def apply_fill_nulls(df: DataFrame, c: str, params: dict) -> DataFrame:
    t = params["type"]
    filled = F.coalesce(q(c).cast(t), F.lit(params["value"]).cast(t)) if params["value"] is not None else q(c).cast(t)
    return df.withColumn(c, filled)


def fill_nulls(df: DataFrame, c: str, strategy: str, value=None) -> DataFrame:
    return apply_fill_nulls(df, c, fit_fill_nulls(df, c, strategy, value))
