"""Profiles that are stored and merged (A1-A5 for tables that grow).

A *profile state* is a small table, one row per column and slice of the data (a day, a file, a partition): counts, nulls,
extremes, moments, a KLL quantile sketch and a HyperLogLog sketch.  States of disjoint slices add up: a new day is profiled
alone and merged with what is stored, and a changed day replaces its own state; nothing rescans the table.

Taking a state is one pass and one partial aggregation per slice, whatever the number of columns; merging reads states
only.  Counts, nulls and extremes of merged states are those of the whole table; mean and deviation too, up to rounding
(moments are merged around each slice's own mean, so large offsets do not cancel); quantiles have a rank error of at most
``RANK_ERROR`` with 99 % confidence, distinct counts a relative one of about ``DISTINCT_ERROR``, merged or not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablab.functions.kinds import is_numeric_type, require_columns
from tablab.functions.long import NAME, q
from tablab.functions.names import private

#: Sizes of the sketches, and their errors at these sizes (normalised rank error of a KLL sketch of k = 800; relative
#: standard error of a HyperLogLog of 2**14 registers, twice).
KLL_K, HLL_LG_K = 800, 14
RANK_ERROR, DISTINCT_ERROR = 0.0035, 0.016

STATE = (
    "slice string, column_name string, dtype string, position int, n_rows bigint, n_nonnull bigint, n_value bigint, mean double, m2 double, "
    "min double, max double, first_text string, last_text string, quantiles binary, distinct binary"
)


def _hashable(c: Column, kind: T.DataType) -> Column:
    """A value that a distinct sketch takes: text and whole numbers as they are, the rest as JSON or text."""
    if isinstance(kind, (T.StringType, T.LongType, T.IntegerType, T.BinaryType)):
        return c
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(F.struct(c.alias("v")))
    return c.cast("string")


def profile_state(df: DataFrame, slice_by: Column | str | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """States (``STATE``) of the columns of ``df`` for every value of ``slice_by`` (a column or expression, as text; null is
    a slice of its own; default: one slice called ``all``).  NaN counts as no value of a number, like everywhere here."""
    cols = list(df.columns if cols is None else cols)
    require_columns(df, cols)
    part, rows = private(df.columns, "slice", "rows")
    by = F.lit("all") if slice_by is None else (q(slice_by) if isinstance(slice_by, str) else slice_by).cast("string")
    facts = []
    for i, c in enumerate(cols):
        kind, v = df.schema[c].dataType, q(c)
        number = is_numeric_type(kind)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            v = F.nanvl(v, F.lit(None).cast(kind))
        x = v.cast("double") if number else F.lit(None).cast("double")
        text = F.lit(None).cast("string") if number or isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.BinaryType)) else v.cast("string")
        facts.append(F.struct(
            F.lit(c).alias(NAME), F.lit(kind.simpleString()).alias("dtype"), F.lit(i).alias("position"), F.count(v).alias("n_nonnull"),
            F.count(x).alias("n_value"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.min(text).alias("first_text"), F.max(text).alias("last_text"),
            (F.kll_sketch_agg_double(x, F.lit(KLL_K)) if number else F.lit(None).cast("binary")).alias("quantiles"),
            F.hll_sketch_agg(_hashable(v, kind), F.lit(HLL_LG_K)).alias("distinct"),
        ))
    if not cols:
        return df.sparkSession.createDataFrame([], STATE)
    grouped = df.withColumn(part, by).groupBy(part).agg(F.count(F.lit(1)).alias(rows), F.array(*facts).alias("state"))
    flat = grouped.select(F.col(part).alias("slice"), F.col(rows).alias("n_rows"), F.inline("state"))
    return flat.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(STATE).fields])


def replace_slices(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """``stored`` states with those of the slices in ``fresh`` taken from there: a reloaded day counts once."""
    days = fresh.select(F.col("slice").alias("fresh_slice")).distinct()
    return stored.join(days, stored["slice"].eqNullSafe(F.col("fresh_slice")), "left_anti").unionByName(fresh)


def merge_states(states: DataFrame, slice_name: str = "all") -> DataFrame:
    """One state per column from those of disjoint slices.  A column whose type changed between slices has one row per
    type; a column that some slices lack counts the rows of the others only."""
    total = F.sum("n_value")
    weighted = F.sum(F.col("mean") * F.col("n_value"))
    moved = states.join(
        states.groupBy(F.col(NAME).alias("cn"), F.col("dtype").alias("cd")).agg((F.sum(F.col("mean") * F.col("n_value")) / F.nullif(F.sum("n_value"), F.lit(0))).alias("centre")),
        (F.col(NAME) == F.col("cn")) & (F.col("dtype") == F.col("cd")),
    )
    off = F.col("mean") - F.col("centre")
    return moved.groupBy(NAME, "dtype").agg(
        F.lit(slice_name).alias("slice"), F.min("position").alias("position"), F.sum("n_rows").alias("n_rows"), F.sum("n_nonnull").alias("n_nonnull"),
        total.alias("n_value"), (weighted / F.nullif(total, F.lit(0))).alias("mean"),
        F.sum(F.col("m2") + F.col("n_value") * off * off).alias("m2"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.min("first_text").alias("first_text"), F.max("last_text").alias("last_text"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct", False).alias("distinct"),
    ).select(*[f.name for f in T._parse_datatype_string(STATE).fields])


def read_state(states: DataFrame, percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile that states hold: per slice and column n_rows, n_null, n_distinct (estimated, whole), count, mean, std,
    min, the percentiles (of the sketch: values of the data), max; for other columns the first and last text."""
    has = F.col("n_value") > 0
    out = [F.when(has, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p)))).alias(f"p{f'{p * 100:.10g}'.replace('.', '_')}") for p in percentiles]
    return states.select(
        "slice", NAME, "dtype", "n_rows", (F.col("n_rows") - F.col("n_nonnull")).alias("n_null"),
        F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)).alias("n_distinct"), F.col("n_value").alias("count"), "mean",
        F.when(F.col("n_value") > 1, F.sqrt(F.col("m2") / (F.col("n_value") - 1))).alias("std"), "min", *out, "max", "first_text", "last_text", "position",
    )


def rank_of(states: DataFrame, values: Sequence[float]) -> DataFrame:
    """Per slice and column, the share of values up to each of ``values`` by the sketch: drift between stored slices
    without the data.  Columns without a value have no row."""
    at = F.array(*[F.lit(float(v)) for v in values])
    ranks = F.kll_sketch_get_rank_double("quantiles", at)
    pairs = F.explode(F.arrays_zip(at.alias("value"), ranks.alias("rank"))).alias("at")
    return states.where(F.col("n_value") > 0).select("slice", NAME, pairs).select("slice", NAME, F.col("at")["value"].alias("value"), F.col("at")["rank"].alias("rank"))
