"""Further registered queries: bounded chart frames, stored and merged profiles, and what came after them.  Same rules as
:mod:`tablab.plans.catalog`, whose tables these queries join."""

from __future__ import annotations


from tablab.operators import charts as G
from tablab.operators import metrics as M
from tablab.plans.catalog import REG_PRED, reg_predictions, register, rounded
from tablab.sources.tables import load


# ================================================================ G1, G4, G9, M21 with max_points
def _envelope_sql(table: str, x: str, at: str, y: str, series: str, most: int) -> str:
    return f"""
WITH e AS (SELECT {x}, {at} AS px, {y}, {series} FROM {table}),
s AS (SELECT {series}, count(*) AS n, min(px) AS mn, max(px) AS mx FROM e GROUP BY {series}),
b AS (SELECT e.*, n, least(floor((px - mn) / (mx - mn) * {most // 4}), {most // 4 - 1}) AS bucket FROM e JOIN s USING ({series})),
r AS (SELECT *, row_number() OVER (PARTITION BY {series}, bucket ORDER BY {x}, {y}) AS f, row_number() OVER (PARTITION BY {series}, bucket ORDER BY {x} DESC, {y} DESC) AS l,
             row_number() OVER (PARTITION BY {series}, bucket ORDER BY {y}, {x}) AS lo, row_number() OVER (PARTITION BY {series}, bucket ORDER BY {y} DESC, {x} DESC) AS hi FROM b)
SELECT {x}, {y}, {series} FROM r WHERE n <= {most} UNION ALL
SELECT DISTINCT {x}, {y}, {series} FROM r WHERE n > {most} AND 1 IN (f, l, lo, hi)"""


@register("line_max_points", _envelope_sql("events", "event_id", "event_id::DOUBLE", "value", "event_type", 120))
def line_max_points(spark, sf):
    return G.line_data(load(spark, sf, "events"), "event_id", "value", color="event_type", max_points=120)


@register("line_max_points_time", _envelope_sql("orders", "o_orderdate", "epoch(o_orderdate)::DOUBLE", "o_totalprice", "o_orderpriority", 200))
def line_max_points_time(spark, sf):
    return G.line_data(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", facet_col="o_orderpriority", max_points=200)


_HASH = "('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, '42')), 1, 8))::BIGINT"


@register(
    "scatter_max_points",
    f"""WITH h AS (SELECT l_quantity, l_extendedprice, l_linestatus, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY {_HASH},
               l_quantity, l_extendedprice, l_linestatus, l_orderkey, l_linenumber) AS n FROM lineitem)
        SELECT l_quantity, l_extendedprice, l_linestatus, l_returnflag FROM h WHERE n <= 300""",
)
def scatter_max_points(spark, sf):
    return G.scatter_data(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", color="l_linestatus", facet_col="l_returnflag",
                          max_points=300, key=["l_orderkey", "l_linenumber"])


@register(
    "scatter_matrix_max_points",
    f"""WITH h AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, row_number() OVER (ORDER BY {_HASH}, l_quantity, l_extendedprice, l_discount,
               l_tax, l_orderkey, l_linenumber) AS n FROM lineitem)
        SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM h WHERE n <= 500""",
)
def scatter_matrix_max_points(spark, sf):
    return G.scatter_matrix_data(load(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], max_points=500,
                                 key=["l_orderkey", "l_linenumber"])


@register(
    "residual_max_points",
    f"""WITH {REG_PRED}, h AS (SELECT *, row_number() OVER (ORDER BY {_HASH}, l_orderkey, l_linenumber, label, prediction) AS n FROM p)
        SELECT l_orderkey, l_linenumber, round(prediction, 6) AS prediction, round(label - prediction, 6) AS residual FROM h WHERE n <= 400""",
)
def residual_max_points(spark, sf):
    return rounded(M.residual_data(reg_predictions(spark, sf), keep=["l_orderkey", "l_linenumber"], max_points=400, key=["l_orderkey", "l_linenumber"]))


# ================================================================ A1-A5 stored and merged
from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tablab.operators import stored_profile as S  # noqa: E402
from tablab.plans.catalog import LI_NULLS, lineitem_nulls  # noqa: E402
from tablab.session import scratch_path  # noqa: E402

_PROFILED = ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_partkey")


def _profile_sql(source: str, cols, where: str = "true") -> str:
    one = """SELECT '{c}' AS column_name, count(*)::BIGINT AS n_rows, (count(*) - count({c}))::BIGINT AS n_null, {v} FROM s"""
    number = "count({c})::BIGINT AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, NULL::VARCHAR AS first_text, NULL::VARCHAR AS last_text"
    text = "0::BIGINT AS count, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS max, min({c}) AS first_text, max({c}) AS last_text"
    parts = [one.format(c=c, v=(text if c.endswith("flag") else number).format(c=c)) for c in cols]
    return f"WITH {LI_NULLS}, s AS (SELECT * FROM {source} WHERE {where}) " + " UNION ALL ".join(parts)


def _exact_parts(states):
    return rounded(S.read_state(states).select("column_name", "n_rows", "n_null", "count", "mean", "std", "min", "max", "first_text", "last_text"))


def _stored(states):
    """The states as the table that a job of another day would read."""
    path = scratch_path(states.sparkSession, "profile")
    states.write.parquet(path)
    return states.sparkSession.read.schema(states.schema).parquet(path)


@register("profile_merged", _profile_sql("li", _PROFILED))
def profile_merged(spark, sf):
    """One stored state per supplier group, merged: equal to the profile of the whole table."""
    li = lineitem_nulls(spark, sf)
    return _exact_parts(S.merge_states(_stored(S.profile_state(li, F.col("l_suppkey") % 30, _PROFILED))))


@register("profile_new_slice", _profile_sql("li", _PROFILED, "l_suppkey % 30 < 28"))
def profile_new_slice(spark, sf):
    """Stored slices 0 to 20 (20 from other rows, as before a reload), then 20 to 27 profiled alone and merged in."""
    li = lineitem_nulls(spark, sf).withColumn("part", F.col("l_suppkey") % 30)
    stale = li.where("part <= 20").withColumn("l_quantity", F.when(F.col("part") == 20, -1e9).otherwise(F.col("l_quantity")))
    stored = _stored(S.profile_state(stale, "part", _PROFILED))
    fresh = S.profile_state(li.where("part between 20 and 27"), "part", _PROFILED)
    return _exact_parts(S.merge_states(S.replace_slices(stored, fresh)))


@register(
    "profile_quantile_ranks",
    f"""WITH {LI_NULLS}, s AS (SELECT l_quantity AS v FROM li WHERE l_quantity IS NOT NULL), n AS (SELECT count(*) AS n FROM s),
        x AS (SELECT unnest(range(1, 51))::DOUBLE AS value)
        SELECT value, round(count(s.v) / any_value(n), 1) AS share FROM x JOIN s ON s.v <= value, n
        GROUP BY value HAVING abs(count(s.v) / any_value(n) * 10 - floor(count(s.v) / any_value(n) * 10) - 0.5) > 0.1""",
)
def profile_quantile_ranks(spark, sf):
    """Share of l_quantity up to 1 ... 50 from merged sketches, to one decimal; values whose share lies near the edge of a
    rounding step (within a hundredth, three times the sketch's error) are left to the tests."""
    merged = S.merge_states(_stored(S.profile_state(lineitem_nulls(spark, sf), F.col("l_suppkey") % 30, ["l_quantity"])))
    got = S.rank_of(merged, range(1, 51)).select("value", F.col("rank").alias("share"))
    counts = lineitem_nulls(spark, sf).where("l_quantity is not null").groupBy(F.col("l_quantity").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    # one row for each of the 50 whole values
    upto = counts.withColumn("true", F.sum("n").over(Window.orderBy("value")) / F.sum("n").over(Window.partitionBy())).select("value", "true")
    inner = F.abs(F.col("true") * 10 - F.floor(F.col("true") * 10) - 0.5) > 0.1
    return got.join(upto, "value").where(inner).select("value", F.round("share", 1).alias("share"))


# ================================================================ M11 over a stored index
from tablab.operators import ann as A  # noqa: E402

_FEATURES = {"a": "o_totalprice / 3000", "b": "o_custkey % 97 * 1.0D", "c": "(o_orderkey * 7919) % 101 / 2.0D"}
_KNN_SQL = f"""
t AS (SELECT o_orderkey, o_orderstatus, {", ".join(f"{e.replace('D', '')} AS {n}" for n, e in _FEATURES.items())} FROM orders),
s AS (SELECT q.o_orderkey, t.o_orderkey AS neighbor_o_orderkey, t.o_orderstatus,
             sqrt((q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) + (q.c - t.c) * (q.c - t.c)) AS distance
      FROM t q JOIN t ON q.o_orderkey % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY distance, neighbor_o_orderkey)::INT AS rank FROM s)"""


def _index_and_queries(spark, sf):
    li = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", *[F.expr(e).alias(n) for n, e in _FEATURES.items()])
    index = A.build_index(li, scratch_path(spark, "index"), ["o_orderkey"], list(_FEATURES), "o_orderstatus")
    return index, li.where("o_orderkey % 50 = 0")


@register(
    "knn_index_exact",
    f"""WITH {_KNN_SQL} SELECT o_orderkey, rank, neighbor_o_orderkey, round(distance, 6) AS distance, o_orderstatus
        FROM r WHERE rank <= 5""",
)
def knn_index_exact(spark, sf):
    """Index search, with the exact search for queries that the certificate leaves open."""
    index, asked = _index_and_queries(spark, sf)
    return rounded(A.search(index, asked, ["o_orderkey"], list(_FEATURES), 5, exact=True).drop("certain"))


@register(
    "knn_index_recall",
    f"""WITH {_KNN_SQL} SELECT count(*)::BIGINT AS neighbours, true AS recall_90, sum(o_orderkey % 7)::BIGINT AS queries_sum FROM r WHERE rank <= 5""",
)
def knn_index_recall(spark, sf):
    """The index alone: as many neighbours as the exact search finds, at least nine in ten of them the same distance."""
    index, asked = _index_and_queries(spark, sf)
    key = ["o_orderkey"]
    got = A.search(index, asked, key, list(_FEATURES), 5).select(*key, "rank", F.col("distance").alias("near"))
    true = A.search(index, asked, key, list(_FEATURES), 5, exact=True).select(*key, "rank", "distance")
    hit = F.avg((F.col("near") <= F.col("distance")).cast("double"))
    return got.join(true, [*key, "rank"]).agg(F.count(F.lit(1)).alias("neighbours"), (hit >= 0.9).alias("recall_90"), F.sum(F.col("o_orderkey") % 7).alias("queries_sum"))


# ================================================================ L1, A9 by position
from tablab.operators import clean as C  # noqa: E402
from tablab.sources import tables as TB  # noqa: E402


@register("preview_by_position", "SELECT * FROM orders LIMIT 50")
def preview_by_position(spark, sf):
    return TB.head(spark, f"{sf.rstrip('/')}/orders.parquet", 50)


@register(
    "first_of_duplicates",
    """WITH n AS (SELECT *, row_number() OVER () AS place FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY place) AS k FROM n)
       SELECT event_id, event_type, user_id, round(value, 6) AS value FROM r WHERE k = 1""",
)
def first_of_duplicates_q(spark, sf):
    rows = TB.read_positioned(spark, f"{sf.rstrip('/')}/events.parquet")
    return rounded(C.first_of_duplicates(rows, ["event_type", "user_id"]).select("event_id", "event_type", "user_id", "value"))


# ================================================================ M16 without points on straight lines


@register(
    "roc_without_collinear",
    """WITH p AS (SELECT l_linestatus AS g, (l_returnflag = 'R')::INT AS y, round(l_extendedprice / 500) AS s FROM lineitem),
       c AS (SELECT g, s, sum(y) AS pos, count(*) - sum(y) AS neg FROM p GROUP BY g, s),
       k AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, lag(s) OVER w AS prev, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
                    sum(pos) OVER (PARTITION BY g) AS allp, sum(neg) OVER (PARTITION BY g) AS alln FROM c WINDOW w AS (PARTITION BY g ORDER BY s DESC))
       SELECT g, s AS threshold, round(fp / alln, 6) AS fpr, round(tp / allp, 6) AS tpr FROM k WHERE prev IS NULL OR np IS NULL OR np <> pos OR nn <> neg
       UNION ALL SELECT DISTINCT g, 'Infinity'::DOUBLE, 0.0, 0.0 FROM c""",
)
def roc_without_collinear(spark, sf):
    p = load(spark, sf, "lineitem").select(F.col("l_linestatus").alias("g"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
                                           F.round(F.col("l_extendedprice") / 500).alias("score"))
    return rounded(M.roc_curve(p, keys=["g"], drop_intermediate=True))


# ================================================================ U7 beyond 1,000 clusters
@register(
    "silhouette_many_clusters",
    """WITH p AS (SELECT o_orderkey AS id, o_custkey % 1300 AS c, o_totalprice / 10000 AS x, (o_orderkey * 7919) % 101 / 5.0 AS y FROM orders),
       m AS (SELECT c, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x * x + y * y) AS q FROM p GROUP BY c),
       d AS (SELECT p.id, p.c AS own, m.c, m.n, greatest(p.x * p.x + p.y * p.y - 2 * (p.x * m.mx + p.y * m.my) + m.q, 0) AS d FROM p, m),
       s AS (SELECT id, max(CASE WHEN own = c THEN n END) AS n, max(CASE WHEN own = c AND n > 1 THEN d * n / (n - 1) END) AS a, min(CASE WHEN own <> c THEN d END) AS b FROM d GROUP BY id)
       SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette FROM s""",
)
def silhouette_many_clusters(spark, sf):
    from tablab.operators.silhouette import silhouette

    p = load(spark, sf, "orders").select((F.col("o_custkey") % 1300).alias("cluster"),
                                         F.array(F.col("o_totalprice") / 10000, (F.col("o_orderkey") * 7919) % 101 / 5.0).alias("features"))
    return rounded(silhouette(p))


# ================================================================ M4, M9, M10: what a fit reached
from tablab.operators import forests as FO  # noqa: E402
from tablab.operators import supervised as SV  # noqa: E402


@register("forest_node_sizes")
def forest_node_sizes(spark, sf):
    """Splits and smallest split node of every tree, cut at 40 rows."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    got = SV.train_model(li, ["l_quantity", "l_discount"], "l_extendedprice", "random_forest", "regression", key=["l_orderkey", "l_linenumber"],
                         n_estimators=5, max_depth=8, min_samples_split=40)
    return FO.node_sizes(spark, got.model.last_stage)


@register("fit_convergence")
def fit_convergence(spark, sf):
    """Steps of the SVR's solver and whether it settled."""
    cu = spread(load(spark, sf, "customer")).select("c_custkey", (F.col("c_custkey") % 50).cast("double").alias("a"), (F.col("c_acctbal") / 1000).alias("y"))
    return SV.convergence(SV.train_model(cu, ["a"], "y", "svr", "regression", key=["c_custkey"], max_iter=15))


# ================================================================ M9, M10 fitted to a duality gap
from tablab.functions.parallel import spread  # noqa: E402

_IN_TEST = "('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, '42')), 1, 8))::BIGINT % 10000 < 2000"


@register(
    "svm_margin",
    f"""SELECT l_orderkey, l_linenumber, (l_quantity > 25)::DOUBLE AS prediction FROM lineitem WHERE l_quantity IS NOT NULL AND {_IN_TEST}""",
)
def svm_margin(spark, sf):
    """Rows that a line separates: within the gap of the optimum no row may lie on the wrong side."""
    li = spread(load(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_quantity") > 25).cast("int").alias("many"))
    got = SV.train_model(li, ["l_quantity"], "many", "svm", "classification", key=["l_orderkey", "l_linenumber"], kernel="linear", landmarks=1, C=1000.0)
    return got.predictions.select("l_orderkey", "l_linenumber", F.col("prediction").cast("double").alias("prediction"))


@register("svm_certificate")
def svm_certificate(spark, sf):
    e = spread(load(spark, sf, "embeddings"))
    return SV.certificates(SV.train_model(e, ["embedding"], "label", "svm", "classification", key=["vec_id"], landmarks=64))


@register("svr_certificate")
def svr_certificate(spark, sf):
    li = spread(load(spark, sf, "lineitem"))
    return SV.certificates(SV.train_model(li, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "svr", "regression",
                                          key=["l_orderkey", "l_linenumber"], landmarks=64))


# ================================================================ S9 as one Spark ML pipeline
from tablab.operators import stages as ST  # noqa: E402
from tablab.plans.catalog import _LI_TRAIN  # noqa: E402


@register(
    "pipeline_export",
    f"""WITH {_LI_TRAIN}, m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS start FROM t)
        SELECT l_orderkey, l_linenumber, round(start + slope * l_quantity, 2) AS prediction FROM lineitem, m WHERE l_quantity IS NOT NULL""",
)
def pipeline_export(spark, sf):
    """Every row predicted by a pipeline that was written and read back."""
    li = load(spark, sf, "lineitem")
    got = SV.train_model(spread(li), ["l_quantity"], "l_extendedprice", "linear", "regression", key=["l_orderkey", "l_linenumber"])
    path = scratch_path(spark, "export")
    ST.export_pipeline(got, path)
    rows = li.where(F.col("l_quantity").isNotNull()).select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(ST.load_pipeline(path).transform(rows).select("l_orderkey", "l_linenumber", "prediction"), 2)
