"""Long-form (unpivoted) views of a table, one branch per value type.

Column-at-a-time statistics over many columns are computed as one grouped
aggregate over ``(column_name, value)`` instead of one ``countDistinct`` per
column (which Catalyst plans as an ``Expand`` with a distinct per column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablab.functions.kinds import is_integral_type, is_numeric_type

NAME = "column_name"
VALUE = "value"


def q(name: str):
    """Column reference that tolerates dots/spaces in names."""
    return F.col(f"`{name}`")


def melt(df: DataFrame, cols: Sequence[str], cast: str, ids: Sequence[str] = ()) -> DataFrame:
    """(ids..., column_name, value) with every value cast to ``cast``."""
    cols = list(cols)
    if not cols:
        raise ValueError("melt needs at least one column")
    sel = df.select(*[q(i) for i in ids], *[q(c).cast(cast).alias(c) for c in cols])
    return sel.unpivot(list(ids), cols, NAME, VALUE)


def type_branches(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Split columns into 'long' (integral), 'double' (other numeric) and
    'string' (everything else) so each branch keeps values exactly."""
    out: dict[str, list[str]] = {"long": [], "double": [], "string": []}
    for c in cols:
        dt = df.schema[c].dataType
        if is_integral_type(dt):
            out["long"].append(c)
        elif is_numeric_type(dt):
            out["double"].append(c)
        else:
            out["string"].append(c)
    return out


def schema_frame(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, dtype, position) from the schema -- metadata, no scan."""
    cols = list(df.columns if cols is None else cols)
    rows = [(c, df.schema[c].dataType.simpleString(), i) for i, c in enumerate(cols)]
    schema = T.StructType(
        [
            T.StructField(NAME, T.StringType(), False),
            T.StructField("dtype", T.StringType(), False),
            T.StructField("position", T.IntegerType(), False),
        ]
    )
    return df.sparkSession.createDataFrame(rows, schema)
