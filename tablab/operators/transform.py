"""Feature transformations (T1-T8) as fit/apply pairs.

``fit_*`` computes the data-dependent constants in one aggregate job and
returns a JSON-serialisable dict; ``apply_*`` is a projection (or, for
label codes, a join) that replays those constants on any table
with the same columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablab.functions.kinds import is_numeric_type, require_columns, require_numeric
from tablab.functions.long import q
from tablab.functions.names import private
from tablab.functions.small import collect_bounded, one_row
from tablab.operators import profile as P
from tablab.session import ensure_checkpoint_dir, scratch_path

# A code table is broadcast when its texts are at most this many characters.
BROADCAST_CHARS = 1 << 20
# Classes that a recipe or model lists, and values that may become columns or classes of a target.
MAX_LISTED, MAX_SCHEMA = 100_000, 10_000
NULL_CLASS = "nan"


def _as_text(df: DataFrame, c: str):
    """Value as text the way pandas ``astype(str)`` sees it; missing -> 'nan'."""
    return F.coalesce(q(c).cast("string"), F.lit(NULL_CLASS))


# ------------------------------------------------------------- T1 label
def dense_codes(values: DataFrame, col: str, partitions: int | None = None) -> DataFrame:
    """(col, code): distinct values numbered 0.. in ascending order, fully
    distributed: range-partition the distinct values, number them within each
    range partition, and offset by the sizes of the preceding partitions (one
    row per partition, so the offset table is bounded by the partition count)."""
    spark = values.sparkSession
    n_parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    pid, size, off, rn = private([col], "pid", "size", "off", "rn")
    ensure_checkpoint_dir(spark)
    d = values.select(q(col)).distinct().repartitionByRange(n_parts, q(col))
    d = d.withColumn(pid, F.spark_partition_id()).checkpoint(eager=True)
    sizes = d.groupBy(pid).agg(F.count(F.lit(1)).alias(size))
    sizes = sizes.withColumn(off, F.sum(size).over(Window.orderBy(pid)) - F.col(size))
    local = d.withColumn(rn, F.row_number().over(Window.partitionBy(pid).orderBy(q(col))) - 1)
    return local.join(F.broadcast(sizes), pid).select(q(col), (F.col(off) + F.col(rn)).cast("bigint").alias("code"))


def fit_label_encode(df: DataFrame, c: str, path: str | None = None) -> dict:
    """Classes sorted by code point; a missing value is the class 'nan'.  Up to
    ``MAX_LISTED`` classes are a list in the recipe or model.  More are a table
    (value, code) written under ``path`` (default: the shared scratch folder),
    numbered without passing the driver; the recipe holds its place, so keep
    the folder as long as the recipe, or give a lasting one."""
    require_columns(df, [c])
    values = df.select(_as_text(df, c).alias("value")).distinct()
    rows = values.limit(MAX_LISTED + 1).collect()
    if len(rows) <= MAX_LISTED:
        return {"classes": sorted(r[0] for r in rows)}
    path = path or scratch_path(df.sparkSession, "classes")
    dense_codes(values, "value").write.mode("overwrite").parquet(path)
    return {"table": path}


def copy_code_table(spark, params: dict, path: str) -> dict:
    """Constants whose class table, if they have one, lies under ``path``."""
    if "table" not in params:
        return params
    spark.read.parquet(params["table"]).write.mode("overwrite").parquet(path)
    return {**params, "table": path}


def fit_classes(df: DataFrame, c: str) -> dict:
    """Classes of a target in the order of its own type (numbers by value),
    nulls aside; more than ``MAX_SCHEMA`` are an error (a model has a weight or
    a count for each)."""
    require_columns(df, [c])
    rows = df.where(q(c).isNotNull()).select(q(c).alias("_v"), q(c).cast("string").alias("_s")).distinct()
    rows = sorted(collect_bounded(rows, MAX_SCHEMA, f"target {c!r}: its classes", structural=False), key=lambda r: r["_v"])
    return {"classes": [r["_s"] for r in rows], "type": df.schema[c].dataType.simpleString()}


def _code_table(df: DataFrame, params: dict, value: str, code: str) -> DataFrame:
    if "table" in params:  # the engine chooses the join by the table's size
        return df.sparkSession.read.parquet(params["table"]).select(F.col("value").alias(value), F.col("code").alias(code))
    classes = params["classes"]
    table = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(classes)], f"{value} string, {code} bigint")
    return F.broadcast(table) if sum(map(len, classes)) <= BROADCAST_CHARS else table


def apply_label_encode(df: DataFrame, c: str, params: dict) -> DataFrame:
    """Replace ``c`` by its integer class code (null for unseen classes)."""
    value, code = private(df.columns, "value", "code")
    joined = df.withColumn(value, _as_text(df, c)).join(_code_table(df, params, value, code), value, "left")
    return joined.select(*[F.col(code).alias(c) if x == c else q(x) for x in df.columns])


def label_encode(df: DataFrame, c: str) -> DataFrame:
    return apply_label_encode(df, c, fit_label_encode(df, c))


# ----------------------------------------------------------- T2 one-hot
def fit_one_hot(df: DataFrame, c: str) -> dict:
    require_columns(df, [c])
    # the values become columns: a schema, which the driver holds anyway
    rows = df.where(q(c).isNotNull()).select(q(c).cast("string").alias("_v")).distinct()
    return {"categories": sorted(r[0] for r in collect_bounded(rows, MAX_SCHEMA, f"{c!r}: its columns", structural=False))}


def apply_one_hot(df: DataFrame, c: str, params: dict) -> DataFrame:
    """Drop ``c``; append boolean ``c_<value>`` per category (null -> all false).  A name that another column has gets a
    number: ``c_<value>_1``."""
    text, taken, dummies = q(c).cast("string"), {x.lower() for x in df.columns if x != c}, []
    for v in params["categories"]:
        name, i = f"{c}_{v}", 0
        while name.lower() in taken:
            i += 1
            name = f"{c}_{v}_{i}"
        taken.add(name.lower())
        dummies.append(F.coalesce(text == F.lit(v), F.lit(False)).alias(name))
    return df.select(*[q(x) for x in df.columns if x != c], *dummies)


def one_hot(df: DataFrame, c: str) -> DataFrame:
    return apply_one_hot(df, c, fit_one_hot(df, c))


# ------------------------------------------------------------ T3-T5 scale
SCALERS = ("standard", "minmax", "robust")


def fit_scale(df: DataFrame, cols: Sequence[str], method: str = "standard") -> dict:
    """Per column (center, scale) so that x' = (x - center) / scale.

    standard: mean and population sd; minmax: min and range; robust: median
    and IQR (exact).  A zero scale becomes 1, so a constant column maps to 0.
    Nulls are ignored by the fit and stay null."""
    cols = list(cols)
    require_numeric(df, cols)
    if method not in SCALERS:
        raise ValueError(f"method must be one of {SCALERS}")
    params: dict[str, list] = {}
    if method in ("standard", "minmax"):
        aggs = []
        for i, c in enumerate(cols):
            x = q(c).cast("double")
            if method == "standard":
                aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"b{i}")]
            else:
                aggs += [F.min(x).alias(f"a{i}"), (F.max(x) - F.min(x)).alias(f"b{i}")]
        row = one_row(df.agg(*aggs))
        for i, c in enumerate(cols):
            params[c] = [row[f"a{i}"], row[f"b{i}"]]
    else:
        qs = P.column_quantiles(df, cols, [0.25, 0.5, 0.75])
        for c in cols:
            q1, med, q3 = qs[c]
            params[c] = [med, None if q1 is None else q3 - q1]
    for c, (center, scale) in params.items():
        params[c] = [center, 1.0 if scale is None or scale == 0 else scale]
    return {"method": method, "columns": params}


def apply_scale(df: DataFrame, params: dict) -> DataFrame:
    cols = params["columns"]
    out = []
    for x in df.columns:
        if x in cols:
            center, scale = cols[x]
            e = (q(x).cast("double") - F.lit(center)) / F.lit(scale) if center is not None else q(x).cast("double")
            out.append(e.alias(x))
        else:
            out.append(q(x))
    return df.select(*out)


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard") -> DataFrame:
    return apply_scale(df, fit_scale(df, cols, method))


# --------------------------------------------------------------- T6 log
def fit_log_transform(df: DataFrame, c: str) -> dict:
    """log1p for the whole column if any value is <= 0, else natural log."""
    return {"log1p": P.any_nonpositive(df, c)}


def apply_log_transform(df: DataFrame, c: str, params: dict) -> DataFrame:
    """Outside the domain (log1p below -1, and -1 itself) the result is NULL
    (numpy gives -inf / NaN; NaN is missing here, -inf is not kept)."""
    x = q(c).cast("double")
    e = F.log1p(x) if params["log1p"] else F.ln(x)
    return df.withColumn(c, e)


def log_transform(df: DataFrame, c: str) -> DataFrame:
    return apply_log_transform(df, c, fit_log_transform(df, c))


# ------------------------------------------------------------ T7 binning
def fit_bin_equal_width(df: DataFrame, c: str, n: int = 3, labels: Sequence[str] | None = None) -> dict:
    """Equal-width, right-closed bins over [min, max] with the lowest edge
    lowered by 0.1 % of the range (pandas ``cut`` with an integer bin count).

    The edges and default interval labels depend only on (min, max, n), so
    they are produced by running ``pandas.cut`` on those two numbers on the
    driver; rows are assigned on the executors by comparing with the edges.
    """
    require_numeric(df, [c])
    if not 2 <= n <= 10:
        raise ValueError("n must be between 2 and 10")
    if labels is not None and len(labels) != n:
        raise ValueError(f"exactly {n} labels are needed, got {len(labels)}")
    row = one_row(df.agg(F.min(q(c).cast("double")).alias("mn"), F.max(q(c).cast("double")).alias("mx")))
    if row["mn"] is None:
        raise ValueError(f"column {c!r} has no non-null value to bin")
    cats, edges = pd.cut(pd.Series([row["mn"], row["mx"]]), bins=n, retbins=True)
    default = [str(iv) for iv in cats.cat.categories]
    return {"edges": [float(e) for e in edges], "labels": list(labels) if labels is not None else default}


def bin_index_expr(x, edges: Sequence[float]):
    """0-based bin of x for right-closed bins (edges[i], edges[i+1]]; null
    outside the edges or for null x."""
    e = None
    for i in range(len(edges) - 1):
        cond = (x > F.lit(edges[i])) & (x <= F.lit(edges[i + 1]))
        e = F.when(cond, F.lit(i)) if e is None else e.when(cond, F.lit(i))
    return e


def apply_bin_equal_width(df: DataFrame, c: str, params: dict, as_index: bool = False) -> DataFrame:
    """Append ``<c>_bin`` (label text, or the 0-based bin number)."""
    x = q(c).cast("double")
    edges = params["edges"]
    if as_index:
        return df.withColumn(f"{c}_bin", bin_index_expr(x, edges))
    e = None
    for i, label in enumerate(params["labels"]):
        cond = (x > F.lit(edges[i])) & (x <= F.lit(edges[i + 1]))
        e = F.when(cond, F.lit(label)) if e is None else e.when(cond, F.lit(label))
    return df.withColumn(f"{c}_bin", e)


def bin_equal_width(df: DataFrame, c: str, n: int = 3, labels: Sequence[str] | None = None) -> DataFrame:
    return apply_bin_equal_width(df, c, fit_bin_equal_width(df, c, n, labels))


# --------------------------------------------------------------- T8 cast
CAST_TARGETS = ("int", "float", "str", "bool")


def cast_column(df: DataFrame, c: str, to: str, strict: bool = True) -> DataFrame:
    """Cast to int (floats truncate), float, str or bool.

    bool follows truthiness: numbers are true when non-zero, text when
    non-empty.  NULL stays NULL for every target.  With ``strict`` a value
    that cannot be converted fails the job (ANSI cast); otherwise it becomes
    NULL (``try_cast``)."""
    require_columns(df, [c])
    if to not in CAST_TARGETS:
        raise ValueError(f"to must be one of {CAST_TARGETS}")
    dt = df.schema[c].dataType
    x = q(c)

    def cast(e, t):
        return e.cast(t) if strict else e.try_cast(t)

    if to == "int":
        if isinstance(dt, T.StringType):
            e = cast(x, "bigint")
        elif isinstance(dt, T.BooleanType):
            e = x.cast("bigint")
        else:
            e = cast(x, "bigint")
    elif to == "float":
        e = cast(x, "double")
    elif to == "str":
        e = x.cast("string")
    else:
        if isinstance(dt, T.BooleanType):
            e = x
        elif is_numeric_type(dt):
            e = x != F.lit(0)
        else:
            e = F.length(x.cast("string")) > 0
    return df.withColumn(c, e)
