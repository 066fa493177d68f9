"""Forest nodes, convergence flags and silhouettes of many clusters, against plain Python."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from tablab.operators import cluster as U
from tablab.operators import forests as T
from tablab.operators import silhouette as S
from tablab.operators import supervised as M


@pytest.fixture(scope="module")
def forest(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(np.sin(a) * 3 + b * b + e)) for a, b, e in zip(rng.random(300) * 6, rng.random(300), rng.normal(size=300) * 0.3)]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(spark.createDataFrame(rows, "a double, b double, label double"))
    return df, RandomForestRegressor(numTrees=4, maxDepth=12, seed=7).fit(df)


@pytest.mark.parametrize("least", [2, 3, 10, 10**6])
def test_cut_trees_follow_the_rule(spark, forest, least):
    df, model = forest
    trees = {}
    for r in T.tree_nodes(spark, model).collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r

    def predict(tree, x):
        at = tree[0]
        while at["left"] >= 0 and at["n_rows"] >= least:
            at = tree[at["left"] if x[at["feature"]] <= at["threshold"] else at["right"]]
        return at["prediction"]

    cut = T.cut_small_nodes(spark, model, least)
    for r in cut.transform(df).collect():
        assert r["prediction"] == pytest.approx(np.mean([predict(t, r["features"]) for t in trees.values()]))
    sizes = T.node_sizes(spark, cut).collect()
    assert len(sizes) == 4 and all(r["least_rows"] is None or r["least_rows"] >= least for r in sizes)
    assert (least > 10**5) == all(r["n_splits"] == 0 for r in sizes)


def test_min_samples_split_reaches_the_model(spark, forest):
    df, _ = forest
    found = {}
    for least in (2, 3, 10):
        got = M.train_model(df.drop("features").withColumn("id", F.monotonically_increasing_id()), ["a", "b"], "label", "random_forest", "regression",
                            key=["id"], n_estimators=3, min_samples_split=least)
        found[least] = got.predictions.count() and sum(r["n_splits"] for r in T.node_sizes(spark, got.model.last_stage).collect())
    assert found[2] > found[3] > found[10] > 0


def test_fits_say_whether_they_converged(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, float(a), float(b), int(a + b > 1), float(a * 3 - b)) for i, (a, b) in enumerate(rng.random((300, 2)))], "id long, a double, b double, y int, z double")
    one = lambda model, target, **p: {r["part"]: r for r in M.convergence(M.train_model(df, ["a", "b"], target, model, key=["id"], **p)).collect()}
    short, long = one("svr", "z", task="regression", max_iter=2)["svr"], one("svr", "z", task="regression", max_iter=200)["svr"]
    assert (short.steps, short.max_steps, short.converged) == (2, 2, False) and long.converged and 2 < long.steps < 200
    assert one("logistic", "y")["logistic"].converged and not one("logistic", "y", max_iter=1)["logistic"].converged
    svm = one("svm", "y", kernel="linear", max_iter=3)
    assert svm["svm"].max_steps == 3 and not svm["svm"].converged and svm["probabilities"].converged
    assert one("random_forest", "y", n_estimators=2) == {}


def plain(x, c):
    x, c = np.asarray(x), np.asarray(c)
    d, out = ((x[:, None] - x[None]) ** 2).sum(axis=2), []
    for i in range(len(x)):
        own = (c == c[i]) & (np.arange(len(x)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a, b = d[i][own].mean(), min(d[i][c == k].mean() for k in set(c.tolist()) - {c[i]})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def test_silhouette_by_blocks_of_clusters(spark, monkeypatch):
    rng = np.random.default_rng(1)
    c = np.concatenate([rng.integers(0, 60, 400), [60, -1, -1]])
    x = rng.normal(size=(len(c), 3)) + np.array([[k % 4, k % 7, k % 3] for k in c]) * 2
    df = spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, c))], "id long, features array<double>, cluster int")
    want = plain(x[c >= 0], c[c >= 0])
    assert S.silhouette(df).first()[0] == pytest.approx(want)
    for block, chain in ((60, 16), (30, 3)):  # many blocks, then the lineage cut in between
        monkeypatch.setattr(S, "BLOCK", block)
        monkeypatch.setattr(S, "CHAIN", chain)
        assert S.silhouette(df).first()[0] == pytest.approx(want)
    monkeypatch.setattr(U, "MAX_SUMS", 5)
    assert U.silhouette_sqeuclidean(df).first()[0] == pytest.approx(want)
    assert S.silhouette(df.where("cluster = 3")).first()[0] is None and S.silhouette(df.limit(0)).first()[0] is None


def test_silhouette_estimate(spark):
    rng = np.random.default_rng(9)
    c = rng.integers(0, 30, 6000)
    x = rng.normal(size=(6000, 2)) + np.stack([c % 6, c // 6], axis=1) * 3
    df = spark.createDataFrame([(i, [float(v) for v in r], int(k)) for i, (r, k) in enumerate(zip(x, c))], "id long, features array<double>, cluster int")
    true, got = S.silhouette(df).first()[0], S.silhouette_estimate(df, "id", 900).first()
    assert 600 < got["n_sampled"] < 1200 and 0 < got["std_error"] < 0.05 and abs(got["silhouette"] - true) < 4 * got["std_error"]
    whole = S.silhouette_estimate(df, "id", 10**6).first()
    assert whole["silhouette"] == pytest.approx(true) and whole["std_error"] == pytest.approx(0, abs=1e-9) and whole["n_sampled"] == 6000
    assert S.silhouette_estimate(df.limit(0), "id", 10).first()["n_sampled"] == 0
