"""Profile and statistics operators.

Each function returns a small DataFrame (one row per column, per group or per
value) and is planned as map-side partial aggregation followed by a final
aggregate on the key, so the shuffled volume is bounded by the number of
distinct keys, never by the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablab.functions.kinds import (
    categorical_columns,
    is_numeric_type,
    numeric_columns,
    require_columns,
    require_numeric,
)
from tablab.functions.long import NAME, VALUE, melt, q, schema_frame, type_branches
from tablab.functions.small import collect_bounded, one_row
from tablab.operators.quantiles import column_quantiles as exact_column_quantiles
from tablab.operators.quantiles import mode_long, quantiles_long, value_counts_long


# ---------------------------------------------------------------- A1 shape
def shape(df: DataFrame) -> DataFrame:
    """One row: n_rows, n_cols."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


# ------------------------------------------------------- A2 column overview
def _branch_overview(df: DataFrame, cols: list[str], cast: str) -> DataFrame:
    vc = value_counts_long(melt(df, cols, cast), [NAME], VALUE)
    return vc.groupBy(NAME).agg(
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum("_c").alias("n_nonnull"),
        F.min(VALUE).cast("string").alias("example"),
    )


def column_overview(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: column_name, dtype, n_distinct (nulls excluded), n_null,
    example (smallest non-null value as text, ``"N/A"`` when none), position.

    Exact distinct counts come from ``groupBy(column_name, value).count()``
    over the unpivoted table (one branch per value type); ``approx=True``
    uses HyperLogLog++ instead, one pass, bounded memory.
    """
    cols = df.columns
    meta = schema_frame(df)
    if approx:
        facts = [
            F.struct(
                F.lit(c).alias(NAME),
                F.approx_count_distinct(q(c)).alias("n_distinct"),
                F.count(q(c)).alias("n_nonnull"),
                F.min(q(c)).cast("string").alias("example"),
            )
            for c in cols
        ]
        stats = df.agg(F.array(*facts).alias("_f")).select(F.inline("_f"))
    else:
        branches = type_branches(df, cols)
        parts = [_branch_overview(df, cs, cast) for cast, cs in branches.items() if cs]
        stats = reduce(DataFrame.unionByName, parts)
    nulls = null_report(df).select(NAME, "n_null")
    out = meta.join(F.broadcast(stats), NAME, "left").join(F.broadcast(nulls), NAME, "left")
    return out.select(
        NAME,
        "dtype",
        F.coalesce("n_distinct", F.lit(0)).cast("bigint").alias("n_distinct"),
        F.col("n_null").cast("bigint").alias("n_null"),
        F.coalesce("example", F.lit("N/A")).alias("example"),
        "position",
    )


# ------------------------------------------------------------ A3/A4 describe
DEFAULT_PERCENTILES = (0.25, 0.5, 0.75)


def pct_name(p: float) -> str:
    s = f"{p * 100:.10g}".replace(".", "_")
    return f"p{s}"


def describe_numeric(
    df: DataFrame, cols: Sequence[str] | None = None, percentiles: Sequence[float] = DEFAULT_PERCENTILES
) -> DataFrame:
    """pandas ``describe()`` for numeric columns, one row per column:
    count, mean, std (ddof=1), min, percentiles (exact, linear), max."""
    cols = list(numeric_columns(df) if cols is None else cols)
    require_numeric(df, cols)
    x = {c: q(c).cast("double") for c in cols}
    facts = [
        F.struct(F.lit(c).alias(NAME), F.count(x[c]).alias("count"), F.avg(x[c]).alias("mean"), F.stddev_samp(x[c]).alias("std"),
                 F.min(x[c]).alias("min"), F.max(x[c]).alias("max"))
        for c in cols
    ]
    base = df.agg(F.array(*facts).alias("_f")).select(F.inline("_f"))
    names = [pct_name(p) for p in percentiles]
    qs = quantiles_frame(df, cols, list(percentiles), names)
    out = schema_frame(df, cols).select(NAME, "position").join(F.broadcast(base), NAME, "left")
    out = out.join(F.broadcast(qs), NAME, "left")
    return out.select(
        NAME, F.coalesce("count", F.lit(0)).cast("bigint").alias("count"), "mean", "std", "min", *names, "max", "position"
    )


def describe(df: DataFrame, percentiles: Sequence[float] = DEFAULT_PERCENTILES, approx: bool = False) -> DataFrame:
    """pandas ``describe(include='all')`` over all columns in one frame, in
    column order; what does not apply to a column is NULL.  ``approx=True``
    takes percentiles from a bounded sketch and distinct counts from
    HyperLogLog++ (top and freq are then left out)."""
    num, cat = numeric_columns(df), categorical_columns(df)
    names = [pct_name(p) for p in percentiles]
    parts = []
    if num and approx:
        x = {c: q(c).cast("double") for c in num}
        rows = [
            F.struct(
                F.lit(c).alias(NAME), F.count(x[c]).alias("count"), F.avg(x[c]).alias("mean"), F.stddev_samp(x[c]).alias("std"),
                F.min(x[c]).alias("min"), *[F.percentile_approx(x[c], p, 10000).alias(n) for n, p in zip(names, percentiles)],
                F.max(x[c]).alias("max"), F.lit(df.columns.index(c)).alias("position"),
            )
            for c in num
        ]
        parts.append(df.agg(F.array(*rows).alias("_r")).select(F.inline("_r")))
    elif num:
        place = F.create_map(*[x for c in num for x in (F.lit(c), F.lit(df.columns.index(c)))])
        parts.append(describe_numeric(df, num, percentiles).withColumn("position", place[F.col(NAME)]))
    if cat and approx:
        rows = [
            F.struct(F.lit(c).alias(NAME), F.count(q(c)).alias("count"), F.approx_count_distinct(q(c)).alias("unique"),
                     F.lit(df.columns.index(c)).alias("position"))
            for c in cat
        ]
        parts.append(df.agg(F.array(*rows).alias("_r")).select(F.inline("_r")))
    elif cat:
        place = F.create_map(*[x for c in cat for x in (F.lit(c), F.lit(df.columns.index(c)))])
        parts.append(describe_categorical(df, cat).withColumn("position", place[F.col(NAME)]))
    if not parts:  # a table without columns
        parts.append(df.sparkSession.createDataFrame([], f"{NAME} string, count bigint, position int"))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    wanted = {"unique": "bigint", "top": "string", "freq": "bigint", "mean": "double", "std": "double", "min": "double",
              **{n: "double" for n in names}, "max": "double"}
    for c, kind in wanted.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    return out.select(NAME, "count", *wanted, "position")


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """pandas ``describe(include='all')`` for non-numeric columns:
    count, unique, top (most frequent, ties -> smallest), freq."""
    cols = list(categorical_columns(df) if cols is None else cols)
    require_columns(df, cols)
    long = melt(df, cols, "string")
    vc = value_counts_long(long, [NAME], VALUE)
    base = vc.groupBy(NAME).agg(F.sum("_c").alias("count"), F.count(F.lit(1)).alias("unique"))
    top = vc.groupBy(NAME).agg(
        F.min_by(VALUE, F.struct((-F.col("_c")).alias("nc"), F.col(VALUE).alias("v"))).alias("top"),
        F.max("_c").alias("freq"),
    )
    out = schema_frame(df, cols).select(NAME, "position").join(F.broadcast(base), NAME, "left")
    out = out.join(F.broadcast(top), NAME, "left")
    return out.select(
        NAME,
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        F.coalesce("unique", F.lit(0)).cast("bigint").alias("unique"),
        "top",
        F.col("freq").cast("bigint").alias("freq"),
        "position",
    )


def column_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles as driver-side constants (bounded: cols x probs)."""
    require_numeric(df, cols)
    return exact_column_quantiles(df, cols, probs)


def quantiles_frame(df: DataFrame, cols: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """(column_name, one column per probability), exact; computed eagerly
    (bounded by cols x probs) and returned as a small DataFrame."""
    got = column_quantiles(df, cols, probs)
    rows = [(c, *[None if v is None else float(v) for v in got[c]]) for c in cols]
    schema = f"{NAME} string, " + ", ".join(f"{n} double" for n in names)
    return df.sparkSession.createDataFrame(rows, schema)


# ------------------------------------------------------------ A5 null report
def null_report(df: DataFrame, only_with_nulls: bool = False) -> DataFrame:
    """column_name, n_null, pct_null (half-even to 2 decimals), position.
    ``only_with_nulls`` keeps rows with n_null > 0 (F8 / G11)."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")] + [
        F.count_if(q(c).isNull()).alias(f"_z{i}") for i, c in enumerate(cols)
    ]
    row = df.agg(*aggs)
    stacked = row.select(
        "_n",
        F.inline(
            F.array(*[F.struct(F.lit(c).alias(NAME), F.col(f"_z{i}").alias("n_null"), F.lit(i).alias("position")) for i, c in enumerate(cols)])
        ),
    )
    out = stacked.select(
        NAME,
        F.col("n_null").cast("bigint").alias("n_null"),
        F.bround(F.try_divide(F.col("n_null") * 100.0, F.col("_n")), 2).alias("pct_null"),
        "position",
    ).fillna({"pct_null": 0.0})
    return out.where(F.col("n_null") > 0) if only_with_nulls else out


# ------------------------------------------------------- A6 correlation
def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation, pairwise-complete, long form (row_name, col_name, corr).

    One pass: per Arrow batch NumPy matrix products give, for every pair of
    columns, the number of rows where both are present and their sums, squares
    and cross products over those rows, on values centred by the column means;
    Spark adds the partial sums (one row per pair and task).  Constant (or
    single-row) pairs give NULL.
    """
    cols = list(numeric_columns(df) if cols is None else cols)
    require_numeric(df, cols)
    if len(cols) < 1:
        raise ValueError("correlation needs at least one numeric column")
    x = df.select(*[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    means = one_row(x.agg(*[F.avg(c).alias(c) for c in x.columns]))
    centre = np.array([means[c] if means[c] is not None and np.isfinite(means[c]) else 0.0 for c in x.columns])
    d = len(cols)

    def partial(batches):
        total = np.zeros((6, d, d))
        for b in batches:
            v = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float) - centre
            there, endless = ~np.isnan(v), np.isinf(v)
            v = np.where(there & ~endless, v, 0.0)
            m, e = there.astype(float), endless.astype(float)
            total += np.stack([m.T @ m, v.T @ m, m.T @ v, (v * v).T @ m, v.T @ v, e.T @ m + m.T @ e])
        i, j = np.indices((d, d))
        flat = [pa.array(a.ravel()) for a in (i, j, *total)]
        yield pa.RecordBatch.from_arrays(flat, names=["i", "j", "n", "sa", "sb", "saa", "sab", "endless"])

    sums = x.mapInArrow(partial, "i long, j long, n double, sa double, sb double, saa double, sab double, endless double")
    sums = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sab", "endless")])
    names = F.array(*[F.lit(c) for c in cols])
    # the squares of the other column of a pair stand in the pair's mirror image
    mirror = sums.select(F.col("i").alias("mj"), F.col("j").alias("mi"), F.col("saa").alias("sbb"))
    both = sums.join(mirror, (F.col("i") == F.col("mi")) & (F.col("j") == F.col("mj")))
    var = lambda s2, s1: s2 - s1 * s1 / F.col("n")
    va, vb = var(F.col("saa"), F.col("sa")), var(F.col("sbb"), F.col("sb"))
    real = (F.col("n") > 0) & (F.col("endless") == 0) & (va > 1e-12 * F.col("saa")) & (vb > 1e-12 * F.col("sbb"))
    r = F.when(real, (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(F.when(real, va * vb)))
    r = F.when((F.col("i") == F.col("j")) & r.isNotNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    name = lambda c: F.element_at(names, (F.col(c) + 1).cast("int"))
    return both.select(name("i").alias("row_name"), name("j").alias("col_name"), F.when(real, r).alias("corr"))


# ---------------------------------------------------- A7 IQR / F7 outliers
def iqr_bounds(df: DataFrame, c: str, k: float = 1.5) -> dict[str, float | None]:
    """Q1, Q3 (exact, linear), IQR and the fences lower/upper as constants."""
    q1, q3 = column_quantiles(df, [c], [0.25, 0.75])[c]
    if q1 is None:
        return {"q1": None, "q3": None, "iqr": None, "lower": None, "upper": None}
    iqr = q3 - q1
    return {"q1": q1, "q3": q3, "iqr": iqr, "lower": q1 - k * iqr, "upper": q3 + k * iqr}


def outlier_rows(df: DataFrame, c: str, k: float = 1.5, bounds: dict | None = None) -> DataFrame:
    """Rows with c < lower or c > upper (strict); null rows never match."""
    b = bounds or iqr_bounds(df, c, k)
    if b["lower"] is None:
        return df.where(F.lit(False))
    return df.where((q(c) < F.lit(b["lower"])) | (q(c) > F.lit(b["upper"])))


def iqr_outliers(df: DataFrame, c: str, k: float = 1.5) -> DataFrame:
    """One row: column_name, q1, q3, iqr, lower, upper, n_outliers,
    pct_outliers (over all rows, nulls included; 0 for an empty table)."""
    require_numeric(df, [c])
    b = iqr_bounds(df, c, k)
    if b["lower"] is None:
        n_out = F.lit(0).cast("bigint")
    else:
        n_out = F.count_if((q(c) < F.lit(b["lower"])) | (q(c) > F.lit(b["upper"])))
    agg = df.agg(n_out.alias("n_outliers"), F.count(F.lit(1)).alias("_n"))
    return agg.select(
        F.lit(c).alias(NAME),
        *[F.lit(b[n]).cast("double").alias(n) for n in ("q1", "q3", "iqr", "lower", "upper")],
        F.col("n_outliers").cast("bigint").alias("n_outliers"),
        F.coalesce(F.try_divide(F.col("n_outliers") * 100.0, F.col("_n")), F.lit(0.0)).alias("pct_outliers"),
    )


# ------------------------------------------------------ A8 duplicates
def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row: n_duplicates = rows equal (nulls equal) to an earlier row."""
    cols = list(df.columns if cols is None else cols)
    g = df.groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


# ----------------------------------------------------- A10 value counts
def value_counts(df: DataFrame, c: str, sort: bool = True) -> DataFrame:
    """(c, count): non-null values, most frequent first, ties by value."""
    require_columns(df, [c])
    out = df.where(q(c).isNotNull()).groupBy(q(c)).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("count"), F.asc(c)) if sort else out


# ---------------------------------------------------- A11 group aggregate
AGG_FUNCS = ("mean", "sum", "median", "min", "max")


def group_agg(df: DataFrame, by: str | Sequence[str], y: str, fn: str = "mean", sort: bool = True) -> DataFrame:
    """pandas ``df.groupby(by)[y].agg(fn)``: rows with a null key are dropped,
    null y values are skipped, the sum of an all-null group is 0, and the
    result is ordered by the keys.  fn in mean, sum, median, min, max."""
    keys = [by] if isinstance(by, str) else list(by)
    require_columns(df, keys)
    require_numeric(df, [y])
    if fn not in AGG_FUNCS:
        raise ValueError(f"fn must be one of {AGG_FUNCS}")
    cond = reduce(lambda a, b: a & b, [q(k).isNotNull() for k in keys])
    own = [f"key{i}" for i in range(len(keys))]  # names of its own on the way, the user's at the end
    base = df.where(cond).select(*[q(k).alias(n) for k, n in zip(keys, own)], q(y).alias("value"))
    if fn == "median":
        groups = base.groupBy(*own).agg(F.count(F.lit(1)).alias("rows"))
        med = quantiles_long(base, own, "value", [0.5], bounded_keys=False).select(*own, F.col("q").alias("value"))
        out = groups.join(med, own, "left").select(*own, "value")
    else:
        fcol = {
            "mean": F.avg("value"),
            "sum": F.coalesce(F.sum("value"), F.lit(0).cast(df.schema[y].dataType)),
            "min": F.min("value"),
            "max": F.max("value"),
        }[fn]
        out = base.groupBy(*own).agg(fcol.alias("value"))
    return (out.orderBy(*own) if sort else out).select(*[F.col(n).alias(k) for k, n in zip(keys, own)], F.col("value").alias(y))


# ------------------------------------------- A12 fill statistics / A13
def column_mean(df: DataFrame, c: str) -> float | None:
    require_numeric(df, [c])
    return one_row(df.agg(F.avg(q(c))))[0]


def column_median(df: DataFrame, c: str) -> float | None:
    return column_quantiles(df, [c], [0.5])[c][0]


def column_mode(df: DataFrame, c: str):
    """Most frequent non-null value, ties -> smallest; None if all null."""
    require_columns(df, [c])
    rows = collect_bounded(mode_long(df.select(F.lit(c).alias("_k"), q(c).alias("_x")), ["_k"], "_x"), 1, "mode")
    return rows[0]["mode"] if rows else None


def any_nonpositive(df: DataFrame, c: str) -> bool:
    require_numeric(df, [c])
    return bool(one_row(df.agg(F.coalesce(F.bool_or(q(c) <= 0), F.lit(False))))[0])


# ---------------------------------------------------- A14 cluster profile
def cluster_profile(df: DataFrame, by: str, cols: Sequence[str], digits: int = 3) -> DataFrame:
    """Mean of each column per group, rounded half-even to ``digits``."""
    require_numeric(df, cols)
    return (
        df.groupBy(q(by))
        .agg(*[F.bround(F.avg(q(c)), digits).alias(c) for c in cols])
        .orderBy(by)
    )


# ----------------------------------------- A15 target validation / A16 task
def validate_target(df: DataFrame, c: str) -> DataFrame:
    """One row: column_name, n_rows, n_distinct, ok, code.

    code: ``missing`` (no such column), ``empty`` (no non-null value),
    ``single_value``, ``identifier`` (as many distinct values as rows: a
    warning, ok stays true) or ``ok``.
    """
    if c not in df.columns:
        return df.sparkSession.createDataFrame(
            [(c, None, None, False, "missing")],
            "column_name string, n_rows bigint, n_distinct bigint, ok boolean, code string",
        )
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(q(c)).alias("n_distinct"))
    code = (
        F.when(F.col("n_distinct") == 0, "empty")
        .when(F.col("n_distinct") == 1, "single_value")
        .when(F.col("n_distinct") == F.col("n_rows"), "identifier")
        .otherwise("ok")
    )
    return agg.select(
        F.lit(c).alias(NAME),
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("n_distinct").cast("bigint").alias("n_distinct"),
        (F.col("n_distinct") >= 2).alias("ok"),
        code.alias("code"),
    )


CLASSIFICATION_MAX_DISTINCT = 10


def detect_task(df: DataFrame, c: str) -> DataFrame:
    """One row: column_name, n_distinct, task ('classification' if the column
    is not numeric or has <= 10 distinct values, else 'regression')."""
    require_columns(df, [c])
    numeric = is_numeric_type(df.schema[c].dataType)
    agg = df.agg(F.countDistinct(q(c)).alias("n_distinct"))
    task = F.when(
        F.lit(not numeric) | (F.col("n_distinct") <= CLASSIFICATION_MAX_DISTINCT), "classification"
    ).otherwise("regression")
    return agg.select(F.lit(c).alias(NAME), F.col("n_distinct").cast("bigint").alias("n_distinct"), task.alias("task"))


def task_of(df: DataFrame, c: str) -> str:
    return one_row(detect_task(df, c))["task"]


# ------------------------------------------------------------ L1 preview
def preview(df: DataFrame, n: int = 50, order_by=None) -> DataFrame:
    """First n rows in key order (a top-n, planned as TakeOrderedAndProject);
    keys are names or ordered columns (``F.desc(...)``).
    Without a key Spark has no row order, so the rows are arbitrary."""
    if order_by is None:
        return df.limit(n)
    keys = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
    return df.orderBy(*[F.asc_nulls_last(k) if isinstance(k, str) else k for k in keys]).limit(n)
