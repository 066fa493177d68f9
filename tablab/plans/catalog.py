"""Registered queries: each name maps to a Spark callable ``(spark, sf_dir) ->
DataFrame`` built from the library's operators, and (where the result is
expressible in SQL) to an equivalent DuckDB query over the same parquet
tables.  Both sides inject NULLs with the same expressions, alias every
computed column identically, and round floating results to 6 decimals so
that summation order does not change the compared values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablab.functions.parallel import spread
from tablab.operators import profile as P
from tablab.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every float column (the comparison is on values, and float sums
    differ in the last bits with summation order)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits).alias(f.name)
        cols.append(c)
    return df.select(*cols)


# ----------------------------------------------------------- null injection
def lineitem_nulls(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    return li.select(
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
        F.when(k % 5 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(k % 11 == 0, None).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(k % 7 == 0, None).otherwise(F.col("l_discount")).alias("l_discount"),
        "l_tax",
        F.when(k % 13 == 0, None).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
    )


LI_NULLS = """
li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
         l_tax,
         CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag,
         l_linestatus
  FROM lineitem)
"""


def part_nulls(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        "p_partkey",
        "p_name",
        F.when(k % 11 == 0, None).otherwise(F.col("p_brand")).alias("p_brand"),
        "p_type",
        F.when(k % 7 == 0, None).otherwise(F.col("p_size")).alias("p_size"),
        F.when(k % 13 == 0, None).otherwise(F.col("p_retailprice")).alias("p_retailprice"),
    )


PART_NULLS = """
pt AS (
  SELECT p_partkey, p_name,
         CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END AS p_brand,
         p_type,
         CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size,
         CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_retailprice END AS p_retailprice
  FROM part)
"""


# ================================================================ A11 / G3
def _group(fn: str):
    def run(spark, sf):
        return rounded(P.group_agg(lineitem_nulls(spark, sf), "l_returnflag", "l_extendedprice", fn))

    return run


_GROUP_SQL = {
    "mean": "avg(l_extendedprice)",
    "sum": "coalesce(sum(l_extendedprice), 0)",
    "median": "quantile_cont(l_extendedprice, 0.5)",
    "min": "min(l_extendedprice)",
    "max": "max(l_extendedprice)",
}
for _fn, _expr in _GROUP_SQL.items():
    register(
        f"group_{_fn}",
        f"WITH {LI_NULLS} SELECT l_returnflag, round({_expr}, 6) AS l_extendedprice "
        "FROM li WHERE l_returnflag IS NOT NULL GROUP BY l_returnflag",
    )(_group(_fn))


@register(
    "bar_by_color",
    """SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 6) AS o_totalprice
       FROM orders GROUP BY o_orderpriority, o_orderstatus""",
)
def bar_by_color(spark, sf):
    return rounded(P.group_agg(load(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"], "o_totalprice", "mean"))


# ================================================================ A10 / G2
@register(
    "value_counts",
    "SELECT event_type, count(*) AS count FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
)
def value_counts_q(spark, sf):
    return P.value_counts(load(spark, sf, "events"), "event_type")


# ================================================================ A1 / A2
@register("shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_cols FROM lineitem")
def shape_q(spark, sf):
    return P.shape(load(spark, sf, "lineitem"))


def _overview_sql() -> str:
    cols = [
        ("p_partkey", "bigint"),
        ("p_name", "string"),
        ("p_brand", "string"),
        ("p_type", "string"),
        ("p_size", "int"),
        ("p_retailprice", "double"),
    ]
    parts = []
    for i, (c, t) in enumerate(cols):
        parts.append(
            f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(DISTINCT {c}) AS n_distinct, "
            f"count(*) - count({c}) AS n_null, coalesce(CAST(min({c}) AS VARCHAR), 'N/A') AS example, "
            f"{i} AS position FROM pt"
        )
    return f"WITH {PART_NULLS} " + " UNION ALL ".join(parts)


@register("column_overview", _overview_sql())
def column_overview_q(spark, sf):
    return P.column_overview(part_nulls(spark, sf))


# ================================================================ A3 / A4
_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _describe_sql(probs) -> str:
    parts = []
    for i, c in enumerate(_NUM):
        qs = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS {P.pct_name(p)}" for p in probs)
        parts.append(
            f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, "
            f"round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, {qs}, "
            f"round(max({c}), 6) AS max, {i} AS position FROM li"
        )
    return f"WITH {LI_NULLS} " + " UNION ALL ".join(parts)


@register("describe_numeric", _describe_sql([0.25, 0.5, 0.75]))
def describe_numeric_q(spark, sf):
    return rounded(P.describe_numeric(lineitem_nulls(spark, sf), _NUM))


_PCTS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


@register("describe_percentiles", _describe_sql(_PCTS))
def describe_percentiles_q(spark, sf):
    return rounded(P.describe_numeric(lineitem_nulls(spark, sf), _NUM, _PCTS))


def _describe_cat_sql() -> str:
    parts = []
    for i, c in enumerate(["o_orderstatus", "o_orderpriority"]):
        parts.append(
            f"""SELECT '{c}' AS column_name, (SELECT count({c}) FROM orders) AS count,
                   (SELECT count(DISTINCT {c}) FROM orders) AS unique,
                   t.v AS top, t.n AS freq, {i} AS position
                FROM (SELECT {c} AS v, count(*) AS n FROM orders WHERE {c} IS NOT NULL
                      GROUP BY {c} ORDER BY n DESC, v LIMIT 1) t"""
        )
    return " UNION ALL ".join(parts)


@register("describe_categorical", _describe_cat_sql())
def describe_categorical_q(spark, sf):
    return P.describe_categorical(load(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"])


# ================================================================ A5 / G11
_LI_COLS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus",
]


def _null_sql(only_positive: bool) -> str:
    parts = [
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, "
        f"round(CAST((count(*) - count({c})) * 100.0 / count(*) AS DOUBLE), 2) AS pct_null, {i} AS position FROM li"
        for i, c in enumerate(_LI_COLS)
    ]
    body = " UNION ALL ".join(parts)
    where = " WHERE n_null > 0" if only_positive else ""
    return f"WITH {LI_NULLS}, r AS ({body}) SELECT * FROM r{where}"


@register("null_report", _null_sql(False))
def null_report_q(spark, sf):
    return P.null_report(lineitem_nulls(spark, sf))


@register("null_bars", _null_sql(True))
def null_bars_q(spark, sf):
    return P.null_report(lineitem_nulls(spark, sf), only_with_nulls=True)


# ================================================================ A6 / G8
def _corr_sql() -> str:
    parts = []
    for a in _NUM:
        for b in _NUM:
            xa = f"CASE WHEN {b} IS NOT NULL THEN {a} END"
            xb = f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            val = f"CASE WHEN stddev_pop({xa}) = 0 OR stddev_pop({xb}) = 0 THEN NULL ELSE corr({a}, {b}) END"
            if a == b:
                val = f"CASE WHEN stddev_pop({a}) = 0 THEN NULL ELSE 1.0 END"
            parts.append(f"SELECT '{a}' AS row_name, '{b}' AS col_name, round({val}, 6) AS corr FROM li")
    return f"WITH {LI_NULLS} " + " UNION ALL ".join(parts)


@register("correlation_matrix", _corr_sql())
def correlation_matrix_q(spark, sf):
    return rounded(P.correlation_matrix(lineitem_nulls(spark, sf), _NUM))


# ================================================================ A7 / F7
_IQR_CTE = """
b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
f AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM b)
"""


@register(
    "iqr_outliers",
    f"""WITH {_IQR_CTE}
        SELECT 'value' AS column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
               round(lower, 6) AS lower, round(upper, 6) AS upper,
               (SELECT count(*) FROM events, f f2 WHERE value < f2.lower OR value > f2.upper) AS n_outliers,
               round((SELECT count(*) FROM events, f f2 WHERE value < f2.lower OR value > f2.upper) * 100.0
                     / (SELECT count(*) FROM events), 6) AS pct_outliers
        FROM f""",
)
def iqr_outliers_q(spark, sf):
    return rounded(P.iqr_outliers(load(spark, sf, "events"), "value"))


@register(
    "outlier_rows",
    f"""WITH {_IQR_CTE}
        SELECT event_id, event_type, value FROM events, f WHERE value < f.lower OR value > f.upper""",
)
def outlier_rows_q(spark, sf):
    return P.outlier_rows(load(spark, sf, "events"), "value").select("event_id", "event_type", "value")


# ================================================================ A8 / A9
@register(
    "duplicate_count",
    """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates FROM
       (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber)""",
)
def duplicate_count_q(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return P.duplicate_count(li)


# ================================================================ A14
@register(
    "cluster_profile",
    f"""WITH {LI_NULLS}
        SELECT l_returnflag, round(avg(l_quantity), 3) AS l_quantity, round(avg(l_discount), 3) AS l_discount
        FROM li GROUP BY l_returnflag""",
)
def cluster_profile_q(spark, sf):
    return P.cluster_profile(lineitem_nulls(spark, sf), "l_returnflag", ["l_quantity", "l_discount"])


# ================================================================ A15 / A16
@register(
    "validate_target",
    """SELECT 'quality' AS column_name, count(*) AS n_rows, count(DISTINCT quality) AS n_distinct,
              count(DISTINCT quality) >= 2 AS ok,
              CASE WHEN count(DISTINCT quality) = 0 THEN 'empty'
                   WHEN count(DISTINCT quality) = 1 THEN 'single_value'
                   WHEN count(DISTINCT quality) = count(*) THEN 'identifier' ELSE 'ok' END AS code
       FROM labels""",
)
def validate_target_q(spark, sf):
    return P.validate_target(load(spark, sf, "labels"), "quality")


@register(
    "detect_task",
    """SELECT 'p_size' AS column_name, count(DISTINCT p_size) AS n_distinct,
              CASE WHEN count(DISTINCT p_size) <= 10 THEN 'classification' ELSE 'regression' END AS task
       FROM part""",
)
def detect_task_q(spark, sf):
    return P.detect_task(load(spark, sf, "part"), "p_size")


# ================================================================ L1
@register(
    "preview",
    """SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders
       ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""",
)
def preview_q(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return P.preview(o, 50, [F.desc("o_totalprice"), "o_orderkey"])


# ================================================================ F5, C1-C4
from tablab.operators import clean as C  # noqa: E402
from tablab.operators import transform as X  # noqa: E402


@register(
    "drop_nulls",
    f"WITH {LI_NULLS} SELECT l_orderkey, l_linenumber, l_discount FROM li WHERE l_discount IS NOT NULL",
)
def drop_nulls_q(spark, sf):
    return C.drop_nulls(lineitem_nulls(spark, sf), ["l_discount"]).select("l_orderkey", "l_linenumber", "l_discount")


def _fill(strategy: str, col: str, value=None):
    def run(spark, sf):
        li = lineitem_nulls(spark, sf)
        return rounded(C.fill_nulls(li, col, strategy, value).select("l_orderkey", "l_linenumber", col))

    return run


register(
    "fill_mean",
    f"""WITH {LI_NULLS} SELECT l_orderkey, l_linenumber,
        round(coalesce(l_discount, (SELECT avg(l_discount) FROM li)), 6) AS l_discount FROM li""",
)(_fill("mean", "l_discount"))
register(
    "fill_median",
    f"""WITH {LI_NULLS} SELECT l_orderkey, l_linenumber,
        round(coalesce(l_extendedprice, (SELECT quantile_cont(l_extendedprice, 0.5) FROM li)), 6) AS l_extendedprice
        FROM li""",
)(_fill("median", "l_extendedprice"))
register(
    "fill_mode",
    f"""WITH {LI_NULLS} SELECT l_orderkey, l_linenumber,
        coalesce(l_returnflag, (SELECT l_returnflag FROM li WHERE l_returnflag IS NOT NULL
                                GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1)) AS l_returnflag
        FROM li""",
)(_fill("mode", "l_returnflag"))
register(
    "fill_value",
    f"""WITH {LI_NULLS} SELECT l_orderkey, l_linenumber, round(coalesce(l_quantity, 0.0), 6) AS l_quantity FROM li""",
)(_fill("value", "l_quantity", "0"))


# ================================================================ F3, F4, T8
@register("drop_columns", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_columns_q(spark, sf):
    return C.drop_columns(load(spark, sf, "customer"), ["c_name", "c_acctbal"])


@register(
    "rename_column",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment AS segment FROM customer",
)
def rename_column_q(spark, sf):
    return C.rename_column(load(spark, sf, "customer"), "c_mktsegment", "segment")


@register("cast_int", "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS c_acctbal FROM customer")
def cast_int_q(spark, sf):
    return X.cast_column(load(spark, sf, "customer"), "c_acctbal", "int").select("c_custkey", "c_acctbal")


@register("cast_str", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer")
def cast_str_q(spark, sf):
    return X.cast_column(load(spark, sf, "customer"), "c_nationkey", "str").select("c_custkey", "c_nationkey")


@register("cast_bool", "SELECT c_custkey, c_nationkey <> 0 AS c_nationkey FROM customer")
def cast_bool_q(spark, sf):
    return X.cast_column(load(spark, sf, "customer"), "c_nationkey", "bool").select("c_custkey", "c_nationkey")


# ================================================================ T1, T2
@register(
    "label_encode",
    """SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1 AS BIGINT) AS c_mktsegment
       FROM customer""",
)
def label_encode_q(spark, sf):
    return X.label_encode(load(spark, sf, "customer"), "c_mktsegment").select("c_custkey", "c_mktsegment")


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register(
    "one_hot",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, "
    + ", ".join(f"coalesce(c_mktsegment = '{v}', false) AS c_mktsegment_{v}" for v in _SEGMENTS)
    + " FROM customer",
)
def one_hot_q(spark, sf):
    return rounded(X.one_hot(load(spark, sf, "customer"), "c_mktsegment"))


# ================================================================ T3-T5
@register(
    "scale_standard",
    """SELECT s_suppkey, round((s_acctbal - (SELECT avg(s_acctbal) FROM supplier))
              / (SELECT CASE WHEN stddev_pop(s_acctbal) = 0 THEN 1 ELSE stddev_pop(s_acctbal) END FROM supplier), 6)
              AS s_acctbal FROM supplier""",
)
def scale_standard_q(spark, sf):
    s = load(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return rounded(X.scale(s, ["s_acctbal"], "standard"))


@register(
    "scale_minmax",
    """WITH m AS (SELECT min(p_retailprice) AS mn, max(p_retailprice) - min(p_retailprice) AS rg FROM part)
       SELECT p_partkey, round((p_retailprice - mn) / CASE WHEN rg = 0 THEN 1 ELSE rg END, 6) AS p_retailprice,
              round((p_size - (SELECT min(p_size) FROM part)) * 1.0 /
                    (SELECT CASE WHEN max(p_size) = min(p_size) THEN 1 ELSE max(p_size) - min(p_size) END FROM part), 6)
              AS p_size
       FROM part, m""",
)
def scale_minmax_q(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return rounded(X.scale(p, ["p_retailprice", "p_size"], "minmax"))


@register(
    "scale_robust",
    """WITH m AS (SELECT quantile_cont(p_size, 0.5) AS med,
                         quantile_cont(p_size, 0.75) - quantile_cont(p_size, 0.25) AS iqr FROM part)
       SELECT p_partkey, round((p_size - med) / CASE WHEN iqr = 0 THEN 1 ELSE iqr END, 6) AS p_size FROM part, m""",
)
def scale_robust_q(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_size")
    return rounded(X.scale(p, ["p_size"], "robust"))


# ================================================================ T6
@register("log_positive", "SELECT p_partkey, round(ln(p_retailprice), 6) AS p_retailprice FROM part")
def log_positive_q(spark, sf):
    return rounded(X.log_transform(load(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice"))


@register(
    "log1p_nonpositive",
    "SELECT c_custkey, round(CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END, 6) AS c_acctbal FROM customer",
)
def log1p_nonpositive_q(spark, sf):
    return rounded(X.log_transform(load(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal"))


# ================================================================ T7
def _bin_case(n: int, then) -> str:
    whens = " ".join(
        f"WHEN p_retailprice > ({'mn - (mx - mn) * 0.001' if i == 0 else f'mn + {i} * ((mx - mn) / {n})'}) "
        f"AND p_retailprice <= ({'mx' if i == n - 1 else f'mn + {i + 1} * ((mx - mn) / {n})'}) THEN {then(i)}"
        for i in range(n)
    )
    return f"CASE {whens} END"


@register(
    "bin_equal_width",
    "WITH s AS (SELECT min(p_retailprice) AS mn, max(p_retailprice) AS mx FROM part) "
    f"SELECT p_partkey, {_bin_case(4, str)} AS p_retailprice_bin FROM part, s",
)
def bin_equal_width_q(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_retailprice")
    params = X.fit_bin_equal_width(p, "p_retailprice", 4)
    return X.apply_bin_equal_width(p, "p_retailprice", params, as_index=True).select("p_partkey", "p_retailprice_bin")


_BIN_LABELS = ["low", "mid", "high"]


@register(
    "bin_labels",
    "WITH s AS (SELECT min(p_retailprice) AS mn, max(p_retailprice) AS mx FROM part) "
    f"SELECT p_partkey, {_bin_case(3, lambda i: repr(_BIN_LABELS[i]))} AS p_retailprice_bin FROM part, s",
)
def bin_labels_q(spark, sf):
    p = load(spark, sf, "part").select("p_partkey", "p_retailprice")
    return X.bin_equal_width(p, "p_retailprice", 3, _BIN_LABELS).select("p_partkey", "p_retailprice_bin")


# ================================================================ A9
@register(
    "drop_duplicates",
    "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
)
def drop_duplicates_q(spark, sf):
    li = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    return C.drop_duplicates(li)


# ================================================================ G1-G11
from tablab.operators import charts as G  # noqa: E402


@register("line_data", "SELECT event_id, value, event_type FROM events")
def line_data_q(spark, sf):
    return G.line_data(load(spark, sf, "events"), "event_id", "value", color="event_type")


@register("scatter_data", "SELECT o_custkey, o_totalprice, o_orderstatus FROM orders")
def scatter_data_q(spark, sf):
    return G.scatter_data(load(spark, sf, "orders"), "o_custkey", "o_totalprice", color="o_orderstatus")


@register(
    "area_data",
    """WITH g AS (SELECT user_id, event_type, coalesce(sum(value), 0) AS value FROM events
                 WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id, event_type)
       SELECT user_id, event_type, round(value, 6) AS value,
              round(sum(value) OVER (PARTITION BY user_id ORDER BY event_type
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS stack_top
       FROM g""",
)
def area_data_q(spark, sf):
    return rounded(G.area_data(load(spark, sf, "events"), "user_id", "value", color="event_type"))


@register(
    "box_data",
    """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q1,
                        quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3
                 FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority),
            f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
       SELECT o.o_orderpriority, count(o_totalprice) AS n, round(min(o_totalprice), 6) AS min,
              round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
              round(max(o_totalprice), 6) AS max,
              round(any_value(lower_fence), 6) AS lower_fence, round(any_value(upper_fence), 6) AS upper_fence,
              round(min(CASE WHEN o_totalprice BETWEEN lower_fence AND upper_fence THEN o_totalprice END), 6) AS whisker_low,
              round(max(CASE WHEN o_totalprice BETWEEN lower_fence AND upper_fence THEN o_totalprice END), 6) AS whisker_high,
              count(CASE WHEN o_totalprice IS NOT NULL AND NOT (o_totalprice BETWEEN lower_fence AND upper_fence)
                         THEN 1 END) AS n_outliers
       FROM orders o JOIN f ON o.o_orderpriority = f.o_orderpriority
       GROUP BY o.o_orderpriority""",
)
def box_data_q(spark, sf):
    return rounded(G.box_data(load(spark, sf, "orders"), "o_orderpriority", "o_totalprice"))


@register(
    "histogram_data",
    """WITH s AS (SELECT min(value) AS mn, max(value) AS mx FROM events),
            b AS (SELECT CAST(least(floor((value - mn) / ((mx - mn) / 10)), 9) AS INTEGER) AS bin
                  FROM events, s WHERE value IS NOT NULL),
            c AS (SELECT bin, count(*) AS count FROM b GROUP BY bin),
            r AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10))
       SELECT r.bin, round(mn + r.bin * ((mx - mn) / 10), 6) AS bin_start,
              round(mn + (r.bin + 1) * ((mx - mn) / 10), 6) AS bin_end, coalesce(c.count, 0) AS count
       FROM r LEFT JOIN c ON r.bin = c.bin, s""",
)
def histogram_data_q(spark, sf):
    return rounded(G.histogram_data(load(spark, sf, "events"), "value", bins=10))


@register(
    "distribution_data",
    "SELECT p_brand, count(*) AS count FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand",
)
def distribution_data_q(spark, sf):
    return G.distribution_data(load(spark, sf, "part"), "p_brand")


def _smatrix_sql(cols, bins) -> str:
    stats = ", ".join(f"min({c}) AS mn_{c}, max({c}) AS mx_{c}" for c in cols)

    def b(c):
        return f"CAST(least(floor(({c} - mn_{c}) / ((mx_{c} - mn_{c}) / {bins})), {bins - 1}) AS INTEGER)"

    parts = [
        f"SELECT '{a}' AS x_col, '{c}' AS y_col, {b(a)} AS x_bin, {b(c)} AS y_bin FROM lineitem, s "
        f"WHERE {a} IS NOT NULL AND {c} IS NOT NULL"
        for a in cols
        for c in cols
        if a != c
    ]
    return (
        f"WITH s AS (SELECT {stats} FROM lineitem), p AS ({' UNION ALL '.join(parts)}) "
        "SELECT x_col, y_col, x_bin, y_bin, count(*) AS count FROM p GROUP BY x_col, y_col, x_bin, y_bin"
    )


_SM_COLS = ["l_quantity", "l_discount", "l_tax"]


@register("scatter_matrix_data", _smatrix_sql(_SM_COLS, 5))
def scatter_matrix_data_q(spark, sf):
    return G.scatter_matrix_data(load(spark, sf, "lineitem"), _SM_COLS, bins=5)


# ================================================================ M2 / M13
from tablab.operators import metrics as M  # noqa: E402
from tablab.operators import split as S  # noqa: E402


def _h(key: str, seed: int = 42) -> str:
    return f"(('0x' || substr(md5(concat_ws('-', CAST({key} AS VARCHAR), '{seed}')), 1, 8))::BIGINT)"


@register("hash_split", f"SELECT o_orderkey, ({_h('o_orderkey')} % 10000) < 2000 AS is_test FROM orders")
def hash_split_q(spark, sf):
    return S.with_test_flag(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2, 42)


@register("kfold", f"SELECT o_orderkey, CAST({_h('o_orderkey')} % 5 AS INTEGER) AS fold FROM orders")
def kfold_q(spark, sf):
    return S.kfold(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 5, 42)


@register(
    "stratified_kfold",
    f"""SELECT doc_id, quality,
               CAST((row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold
        FROM labels""",
)
def stratified_kfold_q(spark, sf):
    lab = load(spark, sf, "labels").select("doc_id", "quality")
    return S.stratified_kfold(lab, "doc_id", "quality", 5, 42)


# ================================================================ M14-M17
def class_predictions(spark, sf) -> DataFrame:
    """labels joined to a rule-based score from the documents table."""
    lab = load(spark, sf, "labels")
    docs = load(spark, sf, "documents").select("doc_id", "n_chars")
    score = F.least(F.col("n_chars"), F.lit(10000)) / 10000.0
    return lab.join(docs, "doc_id").select(
        "doc_id",
        F.col("quality").alias("label"),
        score.alias("score"),
        F.when(score >= 0.5, 1).otherwise(0).alias("prediction"),
    )


CLASS_PRED = """
p AS (SELECT l.doc_id, l.quality AS label, least(d.n_chars, 10000) / 10000.0 AS score,
             CASE WHEN least(d.n_chars, 10000) / 10000.0 >= 0.5 THEN 1 ELSE 0 END AS prediction
      FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


@register(
    "classification_metrics",
    f"""WITH {CLASS_PRED},
        pairs AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM p GROUP BY 1, 2),
        a AS (SELECT actual AS cls, sum(n) AS support, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp
              FROM pairs GROUP BY 1),
        b AS (SELECT predicted AS cls, sum(n) AS npred FROM pairs GROUP BY 1),
        c AS (SELECT coalesce(a.cls, b.cls) AS cls, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
                     coalesce(npred, 0) AS npred FROM a FULL JOIN b ON a.cls = b.cls),
        d AS (SELECT *, CASE WHEN npred = 0 THEN 0 ELSE tp * 1.0 / npred END AS pr,
                        CASE WHEN support = 0 THEN 0 ELSE tp * 1.0 / support END AS rc FROM c),
        e AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f FROM d)
        SELECT round(sum(tp) * 1.0 / sum(support), 6) AS accuracy,
               round(sum(pr * support) / sum(support), 6) AS precision,
               round(sum(rc * support) / sum(support), 6) AS recall,
               round(sum(f * support) / sum(support), 6) AS f1
        FROM e""",
)
def classification_metrics_q(spark, sf):
    return rounded(M.classification_metrics(class_predictions(spark, sf)))


@register(
    "confusion_matrix",
    f"""WITH {CLASS_PRED},
        cls AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
        pairs AS (SELECT label AS actual, prediction AS predicted, count(*) AS n FROM p GROUP BY 1, 2)
        SELECT a.c AS actual, b.c AS predicted, coalesce(n, 0) AS n
        FROM cls a CROSS JOIN cls b LEFT JOIN pairs ON pairs.actual = a.c AND pairs.predicted = b.c""",
)
def confusion_matrix_q(spark, sf):
    return M.confusion_matrix(class_predictions(spark, sf))


_ROC_CTE = f"""{CLASS_PRED},
    g AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                 sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM p GROUP BY score),
    c AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS cum_pos,
                 sum(neg) OVER (ORDER BY score DESC) AS cum_neg,
                 sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM g)
"""


@register(
    "roc_curve",
    f"""WITH {_ROC_CTE}
        SELECT score AS threshold, round(cum_neg * 1.0 / tn, 6) AS fpr, round(cum_pos * 1.0 / tp, 6) AS tpr FROM c
        UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""",
)
def roc_curve_q(spark, sf):
    return rounded(M.roc_curve(class_predictions(spark, sf)))


@register(
    "auc",
    f"""WITH {_ROC_CTE}
        SELECT round(sum(neg * (cum_pos - pos / 2.0)) / (max(tp) * max(tn)), 6) AS auc FROM c""",
)
def auc_q(spark, sf):
    return rounded(M.auc(class_predictions(spark, sf)))


# ================================================================ M18, M21, M22
def reg_predictions(spark, sf) -> DataFrame:
    li = load(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("label"),
        (F.col("l_extendedprice") / 1500.0).alias("prediction"),
    )


REG_PRED = """
p AS (SELECT l_orderkey, l_linenumber, l_quantity AS label, l_extendedprice / 1500.0 AS prediction FROM lineitem)
"""


@register(
    "regression_metrics",
    f"""WITH {REG_PRED}
        SELECT round(avg((label - prediction) * (label - prediction)), 6) AS mse,
               round(sqrt(avg((label - prediction) * (label - prediction))), 6) AS rmse,
               round(avg(abs(label - prediction)), 6) AS mae,
               round(1 - avg((label - prediction) * (label - prediction)) / var_pop(label), 6) AS r2
        FROM p""",
)
def regression_metrics_q(spark, sf):
    return rounded(M.regression_metrics(reg_predictions(spark, sf)))


@register(
    "residual_data",
    f"""WITH {REG_PRED}
        SELECT l_orderkey, l_linenumber, round(prediction, 6) AS prediction, round(label - prediction, 6) AS residual
        FROM p""",
)
def residual_data_q(spark, sf):
    return rounded(M.residual_data(reg_predictions(spark, sf), keep=["l_orderkey", "l_linenumber"]))


def _resdist_sql() -> str:
    return """
    WITH p AS (SELECT l_discount - (l_tax * 0.5 + 0.03) AS r FROM lineitem),
         s AS (SELECT min(r) AS mn, max(r) AS mx, avg(r) AS mu, stddev_pop(r) AS sd, count(r) AS n FROM p),
         b AS (SELECT CAST(least(floor((r - mn) / ((mx - mn) / 30)), 29) AS INTEGER) AS bin FROM p, s WHERE r IS NOT NULL),
         c AS (SELECT bin, count(*) AS cnt FROM b GROUP BY bin),
         rg AS (SELECT CAST(range AS INTEGER) AS bin FROM range(30)),
         h AS (SELECT 'hist' AS kind, round(mn + rg.bin * ((mx - mn) / 30), 6) AS x,
                      round(coalesce(cnt, 0) / (n * ((mx - mn) / 30)), 6) AS y,
                      round(mn + (rg.bin + 1) * ((mx - mn) / 30), 6) AS x_end
               FROM rg LEFT JOIN c ON rg.bin = c.bin, s),
         nc AS (SELECT 'normal' AS kind, round(mu - 4 * sd + range * (8 * sd / 199), 6) AS x,
                       round(exp(-0.5 * pow(((mu - 4 * sd + range * (8 * sd / 199)) - mu) / sd, 2))
                             / (sd * sqrt(2 * pi())), 6) AS y,
                       CAST(NULL AS DOUBLE) AS x_end
                FROM range(200), s)
    SELECT * FROM h UNION ALL SELECT * FROM nc"""


@register("residual_distribution", _resdist_sql())
def residual_distribution_q(spark, sf):
    li = load(spark, sf, "lineitem").select(
        F.col("l_discount").alias("label"), (F.col("l_tax") * 0.5 + 0.03).alias("prediction")
    )
    return rounded(M.residual_distribution(li))


# ================================================================ M4-M13, M19-M20
from tablab.operators import neighbors as NB  # noqa: E402
from tablab.operators import supervised as SV  # noqa: E402


def _hk(keys, seed: int = 42) -> str:
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(('0x' || substr(md5(concat_ws('-', {parts}, '{seed}')), 1, 8))::BIGINT)"


_EMB_SPLIT = f"""
e AS (SELECT vec_id, embedding, label, ({_hk(['vec_id'])} % 10000) < 2000 AS is_test FROM embeddings),
tr AS (SELECT * FROM e WHERE NOT is_test), te AS (SELECT * FROM e WHERE is_test)
"""


@register(
    "knn_classify",
    f"""WITH {_EMB_SPLIT},
        d AS (SELECT te.vec_id AS qid, te.label AS qlabel, tr.vec_id AS tid, tr.label AS tlabel,
                     list_reduce(list_transform(range(1, len(te.embedding) + 1),
                         lambda i: (te.embedding[i]::DOUBLE - tr.embedding[i]::DOUBLE)
                                   * (te.embedding[i]::DOUBLE - tr.embedding[i]::DOUBLE)), lambda a, b: a + b) AS dist
              FROM te, tr),
        nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d),
        v AS (SELECT qid, qlabel, tlabel, count(*) AS c FROM nn WHERE rn <= 5 GROUP BY qid, qlabel, tlabel),
        best AS (SELECT qid, qlabel, tlabel, row_number() OVER (PARTITION BY qid ORDER BY c DESC, tlabel) AS r FROM v)
        SELECT qid AS vec_id, qlabel AS label, tlabel AS prediction FROM best WHERE r = 1""",
)
def knn_classify_q(spark, sf):
    emb = load(spark, sf, "embeddings")
    train, test = S.train_test_split(emb, "vec_id", 0.2, 42)
    return NB.knn_classify(train, test.select("vec_id", "embedding", "label"), "vec_id", "embedding", "label", 5).select(
        "vec_id", "label", "prediction"
    )


_LI_KEY = ["l_orderkey", "l_linenumber"]
_LI_TRAIN = f"t AS (SELECT * FROM lineitem WHERE NOT (({_hk(_LI_KEY)} % 10000) < 2000))"


def _linear_q(model: str):
    def run(spark, sf):
        li = load(spark, sf, "lineitem")
        res = SV.train_model(li, ["l_quantity"], "l_extendedprice", model=model, task="regression",
                             normalize=False, key=_LI_KEY)
        return SV.coefficients(res).select("feature", F.round("coefficient", 4).alias("coefficient"))

    return run


register(
    "ols_one_feature",
    f"""WITH {_LI_TRAIN}
        SELECT 'l_quantity' AS feature, round(regr_slope(l_extendedprice, l_quantity), 4) AS coefficient FROM t
        UNION ALL SELECT '(intercept)', round(regr_intercept(l_extendedprice, l_quantity), 4) FROM t""",
)(_linear_q("linear"))
register(
    "ridge_one_feature",
    f"""WITH {_LI_TRAIN},
        m AS (SELECT covar_pop(l_quantity, l_extendedprice) / (var_pop(l_quantity) + 1.0 / count(*)) AS slope,
                     avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM t)
        SELECT 'l_quantity' AS feature, round(slope, 4) AS coefficient FROM m
        UNION ALL SELECT '(intercept)', round(my - slope * mx, 4) FROM m""",
)(_linear_q("ridge"))


def _model_q(table: str, features, target: str, model: str, key, task=None, **params):
    def run(spark, sf):
        df = spread(load(spark, sf, table))
        res = SV.train_model(df, features, target, model=model, task=task, key=key, **params)
        return res.predictions.select(*key, "label", F.col("prediction").cast("double").alias("prediction"))

    return run


_LI_FEATS = ["l_quantity", "l_discount", "l_tax"]
register("rf_classify")(_model_q("embeddings", ["embedding"], "label", "random_forest", ["vec_id"], max_depth=10))
register("rf_regress")(_model_q("lineitem", _LI_FEATS, "l_extendedprice", "random_forest", _LI_KEY, "regression", max_depth=10))
register("logistic")(_model_q("embeddings", ["embedding"], "label", "logistic", ["vec_id"]))
register("svm_linear")(_model_q("embeddings", ["embedding"], "label", "svm", ["vec_id"], kernel="linear"))
register("svm_rbf")(_model_q("embeddings", ["embedding"], "label", "svm", ["vec_id"], kernel="rbf"))
register("svr")(_model_q("lineitem", _LI_FEATS, "l_extendedprice", "svr", _LI_KEY, "regression"))
register(
    "knn_model",
    f"""WITH {_EMB_SPLIT},
        st AS (SELECT i, avg(tr.embedding[i]::DOUBLE) AS m, stddev_pop(tr.embedding[i]::DOUBLE) AS s
               FROM tr, (SELECT unnest(range(1, 65)) AS i) GROUP BY i),
        sc AS (SELECT list(m ORDER BY i) AS m, list(CASE WHEN s = 0 THEN 1 ELSE s END ORDER BY i) AS s FROM st),
        z AS (SELECT vec_id, label, is_test,
                     list_transform(range(1, 65), lambda i: (embedding[i]::DOUBLE - sc.m[i]) / sc.s[i]) AS embedding FROM e, sc),
        d AS (SELECT te.vec_id AS qid, te.label AS qlabel, tr.vec_id AS tid, tr.label AS tlabel,
                     list_reduce(list_transform(range(1, 65), lambda i: (te.embedding[i] - tr.embedding[i])
                         * (te.embedding[i] - tr.embedding[i])), lambda x, y: x + y) AS dist
              FROM (SELECT * FROM z WHERE is_test) te, (SELECT * FROM z WHERE NOT is_test) tr),
        nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d),
        v AS (SELECT qid, qlabel, tlabel, count(*) AS c FROM nn WHERE rn <= 5 GROUP BY qid, qlabel, tlabel),
        best AS (SELECT qid, qlabel, tlabel, row_number() OVER (PARTITION BY qid ORDER BY c DESC, tlabel) AS r FROM v)
        SELECT qid AS vec_id, qlabel::DOUBLE AS label, tlabel::DOUBLE AS prediction FROM best WHERE r = 1""",
)(_model_q("embeddings", ["embedding"], "label", "knn", ["vec_id"]))


def _ols_sql() -> str:
    """Normal equations of three features by Cramer's rule on centred moments."""
    x, y = _LI_FEATS, "l_extendedprice"
    c = {(i, j): f"covar_pop({x[i]}, {x[j]})" for i in range(3) for j in range(3)}
    moments = ", ".join(f"{v} AS c{i}{j}" for (i, j), v in c.items()) + ", " + ", ".join(f"covar_pop({x[i]}, {y}) AS y{i}" for i in range(3))
    means = ", ".join(f"avg({v}) AS m{i}" for i, v in enumerate(x)) + f", avg({y}) AS my"

    def det(m):
        (a, b, d), (e, f, g), (h, i, j) = m
        return f"({a} * ({f} * {j} - {g} * {i}) - {b} * ({e} * {j} - {g} * {h}) + {d} * ({e} * {i} - {f} * {h}))"

    full = [[f"c{i}{j}" for j in range(3)] for i in range(3)]
    swap = lambda k: [[f"y{i}" if j == k else f"c{i}{j}" for j in range(3)] for i in range(3)]
    slopes = ", ".join(f"{det(swap(k))} / {det(full)} AS b{k}" for k in range(3))
    fit = " + ".join(f"b{i} * ({v} - m{i})" for i, v in enumerate(x))
    return f"""WITH {_LI_TRAIN}, m AS (SELECT {moments}, {means} FROM t), s AS (SELECT *, {slopes} FROM m)
        SELECT l_orderkey, l_linenumber, round({y}, 3) AS label, round(my + {fit}, 3) AS prediction
        FROM lineitem, s WHERE ({_hk(_LI_KEY)} % 10000) < 2000"""


@register("linear_regression", _ols_sql())
def linear_regression_q(spark, sf):
    return rounded(_model_q("lineitem", _LI_FEATS, "l_extendedprice", "linear", _LI_KEY, "regression")(spark, sf), 3)


@register("cross_validate")
def cross_validate_q(spark, sf):
    prep = SV.prepare_xy(load(spark, sf, "lineitem"), _LI_FEATS, "l_extendedprice", _LI_KEY, "regression")
    return SV.cross_validate(prep, "linear", k=5)


@register("feature_importance")
def feature_importance_q(spark, sf):
    li = load(spark, sf, "lineitem")
    res = SV.train_model(li, _LI_FEATS, "l_extendedprice", model="random_forest", task="regression", key=_LI_KEY, max_depth=10)
    return SV.feature_importance(res)


@register("roc_multiclass")
def roc_multiclass_q(spark, sf):
    res = SV.train_model(load(spark, sf, "embeddings"), ["embedding"], "label", model="logistic", key=["vec_id"])
    return SV.roc_curves(res)


# ================================================================ U1-U11
from pyspark.ml.functions import vector_to_array  # noqa: E402

from tablab.operators import cluster as U  # noqa: E402
from tablab.operators.cluster import Points  # noqa: E402

_EMB_DIST = """list_reduce(list_transform(range(1, len({a}) + 1),
                   lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)), lambda x, y: x + y)"""


def _first_centers(spark, sf, k: int = 5):
    emb = load(spark, sf, "embeddings")
    from tablab.functions.hashing import key_hash
    from tablab.functions.small import collect_bounded

    rows = collect_bounded(emb.orderBy(key_hash(["vec_id"], 42), "vec_id").select("embedding").limit(k), k, "centres")
    return emb, [[float(v) for v in r["embedding"]] for r in rows]


@register(
    "kmeans_assign_step",
    f"""WITH c AS (SELECT embedding AS ce, CAST(row_number() OVER (ORDER BY h, vec_id) - 1 AS INTEGER) AS ci
                  FROM (SELECT vec_id, embedding, {_hk(['vec_id'])} AS h FROM embeddings ORDER BY h, vec_id LIMIT 5)),
            d AS (SELECT e.vec_id, c.ci, {_EMB_DIST.format(a='e.embedding', b='c.ce')} AS dist FROM embeddings e, c),
            r AS (SELECT vec_id, ci, row_number() OVER (PARTITION BY vec_id ORDER BY dist, ci) AS rn FROM d)
        SELECT vec_id, ci AS cluster FROM r WHERE rn = 1""",
)
def kmeans_assign_step_q(spark, sf):
    emb, centers = _first_centers(spark, sf)
    return U.assign_nearest(emb, centers, "embedding").select("vec_id", "cluster")


_DBSCAN_CTE = """
pts AS (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
nb AS (SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b
       ON ((0.0 + (a.x - b.x) * (a.x - b.x)) + (a.y - b.y) * (a.y - b.y)) <= 9.0),
cnt AS (SELECT a AS id, count(*) AS n FROM nb GROUP BY a),
core AS (SELECT id FROM cnt WHERE n >= 5),
ce AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
cc(id, comp) AS (SELECT id, id FROM core UNION SELECT ce.b, cc.comp FROM cc JOIN ce ON ce.a = cc.id),
cm AS (SELECT id, min(comp) AS comp FROM cc GROUP BY id),
num AS (SELECT comp, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT comp FROM cm)),
corec AS (SELECT cm.id, num.cluster FROM cm JOIN num ON cm.comp = num.comp),
bord AS (SELECT nb.a AS id, min(corec.cluster) AS cluster FROM nb JOIN corec ON nb.b = corec.id
         WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a),
lab AS (SELECT p.id AS p_partkey, CAST(coalesce(c.cluster, b.cluster, -1) AS INTEGER) AS cluster
        FROM pts p LEFT JOIN corec c ON p.id = c.id LEFT JOIN bord b ON p.id = b.id)
"""


def _dbscan_part(spark, sf):
    pts = U.prepare_points(load(spark, sf, "part"), ["p_size", "p_retailprice"], normalize=False, keep=["p_partkey"])
    return U.dbscan(pts, eps=3.0, min_samples=5, key="p_partkey")


@register("dbscan", f"WITH RECURSIVE {_DBSCAN_CTE} SELECT * FROM lab")
def dbscan_q(spark, sf):
    return _dbscan_part(spark, sf).select("p_partkey", "cluster")


@register(
    "cluster_counts",
    f"""WITH RECURSIVE {_DBSCAN_CTE}
        SELECT count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters,
               count(CASE WHEN cluster = -1 THEN 1 END) AS n_noise FROM lab""",
)
def cluster_counts_q(spark, sf):
    return U.cluster_counts(_dbscan_part(spark, sf))


@register(
    "cluster_display",
    f"""WITH RECURSIVE {_DBSCAN_CTE}
        SELECT p_partkey, cluster, CASE WHEN cluster = -1 THEN 'noise' ELSE CAST(cluster + 1 AS VARCHAR) END AS cluster_label
        FROM lab""",
)
def cluster_display_q(spark, sf):
    return U.cluster_display(_dbscan_part(spark, sf)).select("p_partkey", "cluster", "cluster_label")


@register(
    "dbscan_four_features",
    """WITH RECURSIVE pts AS (SELECT p_partkey AS id, p_size / 10.0::DOUBLE AS a, p_retailprice / 100 AS b,
                                     length(p_name) / 4.0::DOUBLE AS c, length(p_type) / 4.0::DOUBLE AS d FROM part),
       nb AS (SELECT p.id AS a, q.id AS b FROM pts p JOIN pts q
              ON (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b) + (p.c - q.c) * (p.c - q.c) + (p.d - q.d) * (p.d - q.d) <= 0.36),
       core AS (SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= 6),
       ce AS (SELECT a, b FROM nb WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
       cc(id, comp) AS (SELECT id, id FROM core UNION SELECT ce.b, cc.comp FROM cc JOIN ce ON ce.a = cc.id),
       cm AS (SELECT id, min(comp) AS comp FROM cc GROUP BY id),
       num AS (SELECT comp, CAST(dense_rank() OVER (ORDER BY comp) - 1 AS INTEGER) AS cluster FROM (SELECT DISTINCT comp FROM cm)),
       corec AS (SELECT cm.id, num.cluster FROM cm JOIN num ON cm.comp = num.comp),
       bord AS (SELECT nb.a AS id, min(corec.cluster) AS cluster FROM nb JOIN corec ON nb.b = corec.id
                WHERE nb.a NOT IN (SELECT id FROM core) GROUP BY nb.a)
       SELECT p.id AS p_partkey, CAST(coalesce(c.cluster, b.cluster, -1) AS INTEGER) AS cluster
       FROM pts p LEFT JOIN corec c ON p.id = c.id LEFT JOIN bord b ON p.id = b.id""",
)
def dbscan_four_features_q(spark, sf):
    part = load(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") / 10.0).alias("a"), (F.col("p_retailprice") / 100).alias("b"),
        (F.length("p_name") / 4.0).alias("c"), (F.length("p_type") / 4.0).alias("d"),
    )
    pts = U.prepare_points(part, ["a", "b", "c", "d"], normalize=False, keep=["p_partkey"])
    return U.dbscan(pts, eps=0.6, min_samples=6, key="p_partkey").select("p_partkey", "cluster")


def _sil_sql(squared: bool) -> str:
    dist = _EMB_DIST.format(a="a.embedding", b="b.embedding")
    if not squared:
        dist = f"sqrt({dist})"
    return f"""
    WITH d AS (SELECT a.vec_id AS i, a.label AS ca, b.label AS cb, {dist} AS dist FROM embeddings a, embeddings b),
         pc AS (SELECT i, ca, cb, sum(dist) AS s, count(*) AS n FROM d GROUP BY i, ca, cb),
         per AS (SELECT i, max(CASE WHEN ca = cb THEN s / (n - 1) END) AS a, max(CASE WHEN ca = cb THEN n END) AS n_own,
                        min(CASE WHEN ca <> cb THEN s / n END) AS b FROM pc GROUP BY i)
    SELECT round(avg(CASE WHEN n_own <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM per"""


@register("silhouette_exact", _sil_sql(False))
def silhouette_exact_q(spark, sf):
    emb = load(spark, sf, "embeddings")
    return rounded(U.silhouette_euclidean(emb, "vec_id", "embedding", "label"))


@register("silhouette_sqeuclidean", _sil_sql(True))
def silhouette_sq_q(spark, sf):
    emb = load(spark, sf, "embeddings")
    return rounded(U.silhouette_sqeuclidean(emb, "embedding", "label"))


_CLU_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("kmeans")
def kmeans_q(spark, sf):
    pts = U.prepare_points(spread(load(spark, sf, "lineitem")), _CLU_FEATS, keep=_LI_KEY)
    res = U.kmeans(pts, 3)
    return U.cluster_display(res.assign(pts.df)).select(*_LI_KEY, *_CLU_FEATS, "cluster", "cluster_label")


@register(
    "kmeans_fixed_point",
    """SELECT range::INTEGER AS cluster, 0.0::DOUBLE AS shift, (SELECT count(*) FROM lineitem)::BIGINT AS n_rows FROM range(3)""",
)
def kmeans_fixed_point_q(spark, sf):
    """One more step from the fitted centres: how far each cluster's mean lies from its centre (3 decimals)."""
    pts = U.prepare_points(spread(load(spark, sf, "lineitem")), _CLU_FEATS)
    res = U.kmeans(pts, 3, tol=0.0)
    x = vector_to_array("features")
    means = res.assign(pts.df).groupBy("cluster").agg(
        F.array(*[F.avg(F.element_at(x, j + 1)) for j in range(len(_CLU_FEATS))]).alias("m"), F.count(F.lit(1)).alias("n")
    )
    centre = F.array(*[F.array(*[F.lit(v) for v in c]) for c in res.centers])
    gap = F.zip_with("m", F.get(centre, F.col("cluster")), lambda a, b: (a - b) * (a - b))
    total = F.sum("n").over(Window.partitionBy())
    return means.select("cluster", F.round(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, b: a + b)), 3).alias("shift"), total.alias("n_rows"))


@register("elbow_falls", "SELECT range::INTEGER AS k, true AS falls FROM range(2, 7)")
def elbow_falls_q(spark, sf):
    """Inertia falls with every added cluster."""
    pts = U.prepare_points(spread(load(spark, sf, "lineitem")), _CLU_FEATS)
    e = U.elbow(pts, range(2, 8), n_init=3)
    return e.select("k", (F.lead("inertia").over(Window.partitionBy().orderBy("k")) < F.col("inertia")).alias("falls")).where("k < 7")


@register("elbow")
def elbow_q(spark, sf):
    pts = U.prepare_points(spread(load(spark, sf, "lineitem")), _CLU_FEATS)
    return U.elbow(pts)


@register("pca_2d")
def pca_2d_q(spark, sf):
    pts = U.prepare_points(spread(load(spark, sf, "lineitem")), _CLU_FEATS, keep=_LI_KEY + ["l_returnflag"])
    return U.pca_2d(pts, keep=_LI_KEY + ["l_returnflag"])


# ================================================================ R1-R4
from tablab.plans.recipe import Recipe  # noqa: E402

_TAX_LABELS = ["t1", "t2", "t3", "t4"]


def replay_recipe() -> Recipe:
    return (
        Recipe()
        .add("fill_nulls", c="l_discount", strategy="mean")
        .add("scale", cols=["l_quantity"], method="standard")
        .add("log_transform", c="l_extendedprice")
        .add("bin_equal_width", c="l_tax", n=4, labels=_TAX_LABELS)
        .add("drop_columns", cols=["l_partkey", "l_suppkey"])
        .add("rename_column", old="l_returnflag", new="flag")
    )


def _tax_case() -> str:
    whens = " ".join(
        f"WHEN l_tax > ({'mn - (mx - mn) * 0.001' if i == 0 else f'mn + {i} * ((mx - mn) / 4)'}) "
        f"AND l_tax <= ({'mx' if i == 3 else f'mn + {i + 1} * ((mx - mn) / 4)'}) THEN '{_TAX_LABELS[i]}'"
        for i in range(4)
    )
    return f"CASE {whens} END"


@register(
    "recipe_replay",
    f"""WITH {LI_NULLS},
        h AS (SELECT *, ({_hk(_LI_KEY)} % 10000) < 5000 AS fit_half FROM li),
        a AS (SELECT * FROM h WHERE fit_half), b AS (SELECT * FROM h WHERE NOT fit_half),
        s AS (SELECT avg(l_discount) AS fill, avg(l_quantity) AS mu,
                     CASE WHEN stddev_pop(l_quantity) = 0 THEN 1 ELSE stddev_pop(l_quantity) END AS sd,
                     min(l_tax) AS mn, max(l_tax) AS mx FROM a)
        SELECT l_orderkey, l_linenumber, round((l_quantity - mu) / sd, 6) AS l_quantity,
               round(CASE WHEN l_extendedprice > 0 THEN ln(l_extendedprice) END, 6) AS l_extendedprice,
               round(coalesce(l_discount, fill), 6) AS l_discount, round(l_tax, 6) AS l_tax,
               l_returnflag AS flag, l_linestatus, {_tax_case()} AS l_tax_bin
        FROM b, s""",
)
def recipe_replay_q(spark, sf):
    li = lineitem_nulls(spark, sf)
    half = S.with_test_flag(li, _LI_KEY, 0.5, 42, "_fit_half")
    a = half.where(F.col("_fit_half")).drop("_fit_half")
    b = half.where(~F.col("_fit_half")).drop("_fit_half")
    fitted = Recipe.from_json(replay_recipe().fit(a).to_json())  # round-trips through JSON
    return rounded(fitted.apply(b))


# ================================================================ S1-S8
from tablab.session import scratch_path  # noqa: E402
from tablab.sources.delimited import read_delimited, write_delimited  # noqa: E402


@register("csv_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip_q(spark, sf):
    path = scratch_path(spark, "csv-roundtrip")
    write_delimited(load(spark, sf, "nation"), path)
    back = read_delimited(spark, path)
    return back.select(
        F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey")
    )


# ================================================================ any data: repeated rows, nulls, odd files, text targets
@register(
    "knn_duplicate_keys",
    f"""WITH {_EMB_SPLIT},
        d AS (SELECT te.vec_id AS qid, te.label AS qlabel, tr.vec_id AS tid, tr.label AS tlabel,
                     {_EMB_DIST.format(a='te.embedding', b='tr.embedding')} AS dist FROM te, tr),
        nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d),
        v AS (SELECT qid, qlabel, tlabel, count(*) AS c FROM nn WHERE rn <= 5 GROUP BY qid, qlabel, tlabel),
        best AS (SELECT qid, qlabel, tlabel, row_number() OVER (PARTITION BY qid ORDER BY c DESC, tlabel) AS r FROM v)
        SELECT qid % 7 AS vec_id, qlabel AS label, tlabel AS prediction FROM best WHERE r = 1""",
)
def knn_duplicate_keys_q(spark, sf):
    """Query rows that share keys are answered one by one."""
    train, test = S.train_test_split(load(spark, sf, "embeddings"), "vec_id", 0.2, 42)
    test = test.select((F.col("vec_id") % 7).alias("vec_id"), "embedding", "label")
    return NB.knn_classify(train, test, "vec_id", "embedding", "label", 5, cell_target=50, query_target=20).select(
        "vec_id", "label", "prediction"
    )


@register(
    "kmeans_repeated_rows",
    """SELECT l_orderkey, l_linenumber, CAST(l_linenumber - (SELECT min(l_linenumber) FROM lineitem) AS INTEGER) AS cluster,
              0.0::DOUBLE AS inertia FROM lineitem""",
)
def kmeans_repeated_rows_q(spark, sf):
    """As many clusters as distinct points: each point is its own centre."""
    pts = U.prepare_points(spread(load(spark, sf, "lineitem")), ["l_linenumber"], normalize=False, keep=["l_orderkey"])
    k = pts.df.select("l_linenumber").distinct().count()
    res = U.kmeans(pts, k)
    return res.assign(pts.df).select("l_orderkey", "l_linenumber", "cluster", F.round(F.lit(res.inertia), 6).alias("inertia"))


@register(
    "csv_late_encoding",
    """SELECT c_custkey, CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN 'café "' || chr(10) || '" ' || c_name
                              ELSE c_name END AS c_name, c_acctbal FROM customer""",
)
def csv_late_encoding_q(spark, sf):
    """Latin-1 letters and a quoted line break that only the last line has."""
    path = scratch_path(spark, "csv-late")
    c = load(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    last = F.col("c_custkey") == F.lit(c.agg(F.max("c_custkey")).first()[0])
    odd = c.withColumn("c_name", F.when(last, F.concat(F.lit('café "\n" '), "c_name")).otherwise(F.col("c_name")))
    # one sorted file; the writer's encoding and doubled quotes are what an exporting program would use
    odd.repartitionByRange(1, "c_custkey").sortWithinPartitions("c_custkey").write.option("header", True).option(
        "encoding", "ISO-8859-1").option("escape", '"').csv(path)
    return read_delimited(spark, path)


@register(
    "missing_words",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 IN (0, 1, 2) THEN NULL ELSE c_nationkey END::BIGINT AS code,
              CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def missing_words_q(spark, sf):
    from tablab.sources.delimited import infer_numeric, normalize_missing

    k = F.col("c_custkey") % 4
    code = F.when(k == 0, "NA").when(k == 1, " ? ").when(k == 2, "NaN").otherwise(F.col("c_nationkey").cast("string"))
    c = load(spark, sf, "customer").select("c_custkey", code.alias("code"),
                                           F.when(k == 0, "null").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return infer_numeric(normalize_missing(c))


@register(
    "stratified_kfold_nulls",
    f"""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE quality END AS quality FROM labels)
        SELECT doc_id, quality,
               CAST((row_number() OVER (PARTITION BY quality ORDER BY {_h('doc_id')}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM l""",
)
def stratified_kfold_nulls_q(spark, sf):
    lab = load(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("quality")).alias("quality"))
    return S.stratified_kfold(lab, "doc_id", "quality", 5, 42)


@register(
    "exact_split",
    f"""SELECT o_orderkey, row_number() OVER (ORDER BY {_h('o_orderkey')}, o_orderkey) <=
               ceil((SELECT count(*) FROM orders) * 0.3) AS is_test FROM orders""",
)
def exact_split_q(spark, sf):
    return S.with_exact_test_flag(load(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.3, 42)


_KNN_TEXT = f"""{_EMB_SPLIT},
        d AS (SELECT te.vec_id AS qid, te.label AS qlabel, tr.vec_id AS tid, tr.label AS tlabel,
                     {_EMB_DIST.format(a='te.embedding', b='tr.embedding')} AS dist FROM te, tr),
        nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, tid) AS rn FROM d),
        v AS (SELECT qid, qlabel, 'class ' || tlabel AS tl, count(*) AS c FROM nn WHERE rn <= 5 GROUP BY qid, qlabel, tlabel),
        best AS (SELECT qid, 'class ' || qlabel AS a, tl AS p, row_number() OVER (PARTITION BY qid ORDER BY c DESC, tl) AS r FROM v)"""


def _knn_text(spark, sf):
    emb = load(spark, sf, "embeddings").select("vec_id", "embedding", F.concat(F.lit("class "), F.col("label").cast("string")).alias("cls"))
    return SV.train_model(emb, ["embedding"], "cls", model="knn", normalize=False, key=["vec_id"])


@register(
    "confusion_matrix_text",
    f"""WITH {_KNN_TEXT},
        m AS (SELECT a, p, count(*) AS n FROM best WHERE r = 1 GROUP BY a, p),
        c AS (SELECT a AS c FROM m UNION SELECT p FROM m)
        SELECT x.c AS actual, y.c AS predicted, coalesce(m.n, 0)::BIGINT AS n
        FROM c x CROSS JOIN c y LEFT JOIN m ON m.a = x.c AND m.p = y.c""",
)
def confusion_matrix_text_q(spark, sf):
    return SV.confusion(_knn_text(spark, sf))


@register(
    "knn_vote_shares",
    f"""WITH {_KNN_TEXT},
        cls AS (SELECT DISTINCT 'class ' || label AS c FROM embeddings)
        SELECT q.qid AS vec_id, q.a AS actual, cls.c AS class_value, round(coalesce(v.c, 0) / 5.0, 6)::DOUBLE AS score
        FROM (SELECT DISTINCT qid, a FROM best) q CROSS JOIN cls LEFT JOIN v ON v.qid = q.qid AND v.tl = cls.c""",
)
def knn_vote_shares_q(spark, sf):
    res = _knn_text(spark, sf)
    names = F.array(*[F.lit(c) for c in res.prepared.classes])
    shares = res.predictions.select("vec_id", "actual", F.posexplode("probability").alias("i", "score"))
    return shares.select("vec_id", "actual", F.get(names, F.col("i")).alias("class_value"), F.round("score", 6).alias("score"))


@register(
    "cross_validate_one_feature",
    f"""WITH f AS (SELECT l_extendedprice AS y, l_quantity AS x, CAST({_hk(_LI_KEY)} % 5 AS INTEGER) AS fold FROM lineitem),
        k AS (SELECT CAST(range AS INTEGER) AS fold FROM range(5)),
        m AS (SELECT k.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM k, f WHERE f.fold <> k.fold GROUP BY k.fold)
        SELECT m.fold, round(1 - sum((y - a - b * x) * (y - a - b * x)) / (var_pop(y) * count(*)), 6) AS score
        FROM m JOIN f ON f.fold = m.fold GROUP BY m.fold""",
)
def cross_validate_one_feature_q(spark, sf):
    prep = SV.prepare_xy(load(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", _LI_KEY, "regression")
    return rounded(SV.cross_validate(prep, "linear", k=5))


@register(
    "pca_two_features",
    """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp,
                        stddev_pop(l_extendedprice) AS sp FROM lineitem),
            z AS (SELECT l_orderkey, l_linenumber, (l_quantity - mq) / sq AS a, (l_extendedprice - mp) / sp AS b FROM lineitem, s),
            r AS (SELECT corr(a, b) AS r FROM z)
       SELECT l_orderkey, l_linenumber, round(CASE WHEN r > 0 THEN a + b ELSE a - b END / sqrt(2), 4) AS PC1,
              round(CASE WHEN r > 0 THEN a - b ELSE a + b END / sqrt(2), 4) AS PC2_abs FROM z, r""",
)
def pca_two_features_q(spark, sf):
    """Two scaled features: the components are their sum and difference.  Both loadings of a component are equal in size,
    so a component's sign is fixed here by that of the first feature's loading."""
    pts = U.prepare_points(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], keep=_LI_KEY)
    z = [F.element_at(vector_to_array("features"), i + 1) for i in range(2)]
    out = U.pca_2d(Points(pts.df.select(*_LI_KEY, "features", z[0].alias("_a"), z[1].alias("_b")), pts.features, pts.scale),
                   keep=[*_LI_KEY, "_a", "_b"])
    sign = out.agg(F.signum(F.covar_pop("PC1", "_a")).alias("s1"), F.signum(F.covar_pop("PC2", "_a")).alias("s2")).first()
    return out.select(*_LI_KEY, F.round(F.col("PC1") * F.lit(sign["s1"]), 4).alias("PC1"),
                      F.round(F.col("PC2") * F.lit(sign["s2"]), 4).alias("PC2_abs"))


@register(
    "bar_agg_facets",
    """SELECT o_orderpriority, o_orderstatus, year(o_orderdate)::INTEGER AS y, round(max(o_totalprice), 6) AS o_totalprice
       FROM orders GROUP BY ALL""",
)
def bar_agg_facets_q(spark, sf):
    o = load(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return rounded(G.bar_agg_data(o, "o_orderpriority", "o_totalprice", "max", color="o_orderstatus", facet_col="y"))


@register(
    "area_facets",
    """WITH g AS (SELECT o_orderpriority, o_orderstatus, year(o_orderdate)::INTEGER AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
       SELECT y, o_orderstatus, o_orderpriority, round(v, 4) AS o_totalprice,
              round(sum(v) OVER (PARTITION BY y, o_orderpriority ORDER BY o_orderstatus), 4) AS stack_top FROM g""",
)
def area_facets_q(spark, sf):
    o = load(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    return rounded(G.area_data(o, "y", "o_totalprice", color="o_orderstatus", facet_col="o_orderpriority"), 4)


@register(
    "histogram_by_color",
    """WITH s AS (SELECT min(value) AS mn, max(value) AS mx FROM events),
            b AS (SELECT event_type, CAST(least(floor((value - mn) / ((mx - mn) / 10)), 9) AS INTEGER) AS bin
                  FROM events, s WHERE value IS NOT NULL)
       SELECT bin, event_type, round(mn + bin * ((mx - mn) / 10), 6) AS bin_start, round(mn + (bin + 1) * ((mx - mn) / 10), 6) AS bin_end,
              count(*) AS count FROM b, s GROUP BY bin, event_type, mn, mx""",
)
def histogram_by_color_q(spark, sf):
    return rounded(G.histogram_data(load(spark, sf, "events"), "value", bins=10, color="event_type"))


@register("heatmap", _corr_sql())
def heatmap_q(spark, sf):
    return rounded(G.heatmap_data(lineitem_nulls(spark, sf).select(*_NUM)))


@register("cast_float", "SELECT c_custkey, c_nationkey::DOUBLE AS c_nationkey FROM customer")
def cast_float_q(spark, sf):
    return X.cast_column(load(spark, sf, "customer"), "c_nationkey", "float").select("c_custkey", "c_nationkey")


@register("cast_bool_text", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END <> '' AS c_name FROM customer")
def cast_bool_text_q(spark, sf):
    c = load(spark, sf, "customer").withColumn("c_name", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")))
    return X.cast_column(c, "c_name", "bool").select("c_custkey", "c_name")


@register(
    "labelled_export",
    f"""WITH RECURSIVE {_DBSCAN_CTE}
        SELECT p_partkey, CASE WHEN cluster = -1 THEN 'noise' ELSE CAST(cluster + 1 AS VARCHAR) END AS "Cluster" FROM lab""",
)
def labelled_export_q(spark, sf):
    path = scratch_path(spark, "labelled")
    U.export_labelled(_dbscan_part(spark, sf), path, ["p_partkey"])
    return read_delimited(spark, path, as_string=True).select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "Cluster")
