"""Small inline frames for the semantic traps (FIXTURES.md section 2)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablab.operators import charts as G
from tablab.operators import clean as C
from tablab.operators import cluster as U
from tablab.operators import metrics as M
from tablab.operators import neighbors as NB
from tablab.operators import profile as P
from tablab.operators import transform as X
from tablab.sources.tables import nan_to_null


def test_quantiles_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    q = P.column_quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"]
    assert q == pytest.approx([1.75, 3.0, 5.0])


def test_quantiles_partition_independent(spark):
    rows = [(float(i % 97) * 1.5,) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double")
    a = P.column_quantiles(df.repartition(1), ["x"], [0.1, 0.5, 0.9])
    b = P.column_quantiles(df.repartition(13), ["x"], [0.1, 0.5, 0.9])
    assert a == b
    assert a["x"] == pytest.approx(list(np.quantile(np.array([r[0] for r in rows]), [0.1, 0.5, 0.9])))


def test_nan_is_missing_and_mode_tie(spark):
    pdf = pd.DataFrame({"id": [1, 2, 3, 4, 5], "x": [1.0, 2.0, None, float("nan"), 8.0], "c": ["b", "a", "b", "a", None]})
    df = nan_to_null(spark.createDataFrame(pdf))
    rep = {r["column_name"]: r["n_null"] for r in P.null_report(df).collect()}
    assert rep == {"id": 0, "x": 2, "c": 1}
    assert P.column_mode(df, "c") == "a"
    filled = C.fill_nulls(df, "x", "mean").orderBy("id").select("x").collect()
    assert [r[0] for r in filled] == pytest.approx([1.0, 2.0, 11 / 3, 11 / 3, 8.0])


def test_all_null_group_sum_is_zero(spark):
    df = spark.createDataFrame([(1, "g", None), (2, "g", None), (3, "h", 2.0)], "id long, k string, x double")
    out = {r["k"]: r["x"] for r in P.group_agg(df, "k", "x", "sum").collect()}
    assert out == {"g": 0.0, "h": 2.0}


def test_constant_column(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0)], "k double, y double")
    assert [r[0] for r in X.scale(df, ["k"], "standard").collect()] == [0.0, 0.0, 0.0]
    assert [r[0] for r in X.scale(df, ["k"], "minmax").collect()] == [0.0, 0.0, 0.0]
    corr = {(r["row_name"], r["col_name"]): r["corr"] for r in P.correlation_matrix(df).collect()}
    assert corr[("k", "y")] is None and corr[("y", "y")] == 1.0


def test_bins_labels(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (None,)], "x double")
    out = [r["x_bin"] for r in X.bin_equal_width(df, "x", 3).collect()]
    assert out == ["(-0.01, 3.333]", "(3.333, 6.667]", "(6.667, 10.0]", None]


def test_log_domain(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (1.0,)], "x double")
    out = [r[0] for r in X.log_transform(df, "x").collect()]
    assert out[0] is None and out[1] is None
    assert out[2] == 0.0 and out[3] == pytest.approx(math.log(2))


def test_duplicates_null_and_signed_zero(spark):
    df = spark.createDataFrame([(0.0, None), (-0.0, None), (1.0, "a"), (1.0, "a"), (2.0, "b")], "a double, b string")
    assert P.duplicate_count(df).first()[0] == 2
    assert C.drop_duplicates(df).count() == 3


def test_empty_and_one_row(spark):
    empty = spark.createDataFrame([], "x double, c string")
    ov = {r["column_name"]: r for r in P.column_overview(empty).collect()}
    assert ov["x"]["example"] == "N/A" and ov["x"]["n_distinct"] == 0
    assert P.iqr_outliers(empty, "x").first()["pct_outliers"] == 0.0
    one = spark.createDataFrame([(3.0, "z")], "x double, c string")
    d = P.describe_numeric(one).first()
    assert d["mean"] == 3.0 and d["std"] is None and d["p50"] == 3.0


def test_targets(spark):
    df = spark.createDataFrame(
        [(None, 1, i, i % 10, i % 11, str(i % 3)) for i in range(30)],
        "t0 int, t1 int, t_id int, t10 int, t11 int, ts string",
    )
    codes = {c: P.validate_target(df, c).first()["code"] for c in ["t0", "t1", "t_id", "t10", "missing"]}
    assert codes == {"t0": "empty", "t1": "single_value", "t_id": "identifier", "t10": "ok", "missing": "missing"}
    assert P.task_of(df, "t10") == "classification"
    assert P.task_of(df, "t11") == "regression"
    assert P.task_of(df, "ts") == "classification"


def test_scores_ties(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.6), (1, 1, 0.6), (1, 1, 0.9), (1, 0, 0.3)],
                               "label int, prediction int, score double")
    assert M.auc(df).first()["auc"] == pytest.approx(0.75)
    assert M.classification_metrics(df).first()["accuracy"] == pytest.approx(0.6)
    roc = M.roc_curve(df).orderBy("fpr", "tpr").collect()
    assert (roc[0]["fpr"], roc[0]["tpr"]) == (0.0, 0.0) and (roc[-1]["fpr"], roc[-1]["tpr"]) == (1.0, 1.0)


def _brute_silhouette(x, lab, squared):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    if not squared:
        d = np.sqrt(d)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_sil4(spark):
    pts = [(0, 1.0, 2.0, 0), (1, 2.0, 1.0, 0), (2, 4.0, 3.0, 1), (3, 8.0, 9.0, 1)]
    df = spark.createDataFrame(pts, "id long, x double, y double, cluster int").withColumn("f", F.array("x", "y"))
    x = np.array([[p[1], p[2]] for p in pts])
    lab = np.array([p[3] for p in pts])
    e = U.silhouette_euclidean(df, "id", "f", "cluster").first()[0]
    s = U.silhouette_sqeuclidean(df, "f", "cluster").first()[0]
    assert e == pytest.approx(_brute_silhouette(x, lab, False))
    assert s == pytest.approx(_brute_silhouette(x, lab, True))


def _brute_dbscan(x, eps, ms):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    nb = d <= eps
    core = nb.sum(1) >= ms
    comp = -np.ones(n, int)
    c = 0
    for i in range(n):
        if core[i] and comp[i] < 0:
            stack = [i]
            comp[i] = c
            while stack:
                j = stack.pop()
                for m in np.nonzero(nb[j] & core)[0]:
                    if comp[m] < 0:
                        comp[m] = c
                        stack.append(m)
            c += 1
    lab = comp.copy()
    for i in range(n):
        if not core[i]:
            cs = [comp[m] for m in np.nonzero(nb[i] & core)[0]]
            lab[i] = min(cs) if cs else -1
    return lab


@pytest.mark.parametrize("dims", [2, 3])
def test_dbscan_matches_brute_force(spark, dims):
    rng = np.random.default_rng(7)
    blobs = [rng.normal(0, 0.3, (60, dims)), rng.normal(3, 0.3, (60, dims)), rng.uniform(-2, 5, (15, dims))]
    x = np.vstack(blobs)
    x = np.vstack([x, x[:1] + np.r_[0.5, [0.0] * (dims - 1)]])  # a pair at exactly eps
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    cols = [f"c{j}" for j in range(dims)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))
    pts = U.prepare_points(df, cols, normalize=False, keep=["id"])
    got = {r["id"]: r["cluster"] for r in U.dbscan(pts, eps=0.5, min_samples=5, key="id").collect()}
    want = _brute_dbscan(x, 0.5, 5)
    assert [got[i] for i in range(len(x))] == list(want)


@pytest.mark.parametrize("dims", [2, 3])
def test_dbscan_block_edges_match_brute_force(spark, dims, monkeypatch):
    """Every core-cell pair through the cogroup path, cells split into sub-cells."""
    monkeypatch.setattr(U, "JOIN_PAIR_LIMIT", 0)
    monkeypatch.setattr(U, "EDGE_SUB_TARGET", 7)
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 0.3, (80, dims)), rng.normal(2, 0.3, (80, dims)), rng.uniform(-2, 4, (20, dims))])
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    cols = [f"c{j}" for j in range(dims)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))
    pts = U.prepare_points(df, cols, normalize=False, keep=["id"])
    got = {r["id"]: r["cluster"] for r in U.dbscan(pts, eps=0.5, min_samples=5, key="id").collect()}
    assert [got[i] for i in range(len(x))] == list(_brute_dbscan(x, 0.5, 5))


def test_knn_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(3)
    tr = np.round(rng.uniform(0, 5, (200, 3)))  # integer grid: many equal distances
    te = np.round(rng.uniform(0, 5, (40, 3)))
    ytr = rng.integers(0, 3, 200)
    train = spark.createDataFrame([(i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(tr, ytr))],
                                  "id long, f array<double>, label int")
    test = spark.createDataFrame([(1000 + i, [float(v) for v in r], 0) for i, r in enumerate(te)],
                                 "id long, f array<double>, label int")
    got = {r["id"]: r["prediction"] for r in NB.knn_classify(train, test, "id", "f", "label", k=5, pivots=8).collect()}
    for i, q in enumerate(te):
        d = np.sqrt(((tr - q) ** 2).sum(1))
        order = np.lexsort((np.arange(len(tr)), d))[:5]
        votes = np.bincount(ytr[order], minlength=3)
        assert got[1000 + i] == int(np.argmax(votes))


def test_histogram_fills_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (10.0,)], "x double")
    h = G.histogram_data(df, "x", bins=5).collect()
    assert [r["count"] for r in h] == [2, 0, 0, 0, 1]


def test_label_codes_distributed(spark):
    df = spark.createDataFrame([(s,) for s in ["b", "a", None, "c", "a"]], "c string")
    codes = X.dense_codes(df.select(F.coalesce("c", F.lit("nan")).alias("v")), "v")
    assert sorted((r["v"], r["code"]) for r in codes.collect()) == [("a", 0), ("b", 1), ("c", 2), ("nan", 3)]
    keyed = df.withColumn("id", F.monotonically_increasing_id()).checkpoint(eager=True)
    enc = [r["c"] for r in X.label_encode(keyed, "c").orderBy("id").collect()]
    assert enc == [1, 0, 3, 2, 0]
