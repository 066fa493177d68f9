"""Findings of round 4; every test builds its own rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablab.operators import cluster as U


def _cloud(spark, n=20_000):
    return spark.range(n).select(F.rand(1).alias("x0"), F.randn(2).alias("x1"), F.rand(3).alias("x2")).checkpoint()


def _plain_lloyd(x, c, tol, most=300):
    for steps in range(1, most + 1):
        near = U._sq_dists(x, c).argmin(1)
        new = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        shift, c = ((new - c) ** 2).sum(), new
        if shift <= tol:
            break
    return c, U._sq_dists(x, c).min(1).sum(), steps


@pytest.mark.parametrize("tol", [1e-4, 1e-9])
def test_elbow_takes_the_steps_of_plain_lloyd_in_fewer_passes(spark, monkeypatch, tol):
    """a set moves on by the rows that can change their centre, and stands where passes over all rows lead it."""
    vec, rng, passes = _cloud(spark), np.random.default_rng(0), []
    whole = U._open_pass
    monkeypatch.setattr(U, "_open_pass", lambda *a, **k: passes.append(1) or whole(*a, **k))
    inits = {i: rng.random((k, 3)) for i, k in enumerate((2, 3, 5, 5, 9))}
    got, x, steps = U.lloyd(vec, inits, tol=tol), vec.toPandas().to_numpy(), 0
    for i, c in inits.items():
        want, cost, n = _plain_lloyd(x, c, tol * x.var(0).mean())
        np.testing.assert_allclose(got[i][0], want, rtol=1e-9, atol=1e-9)
        assert got[i][1] == pytest.approx(cost)
        steps = max(steps, n)
    assert len(passes) < 0.7 * steps


def test_fixed_point_is_reached(spark, monkeypatch):
    """with tol=0 a set ends when no row changes its centre, whatever order partial sums arrive in."""
    vec, passes = _cloud(spark), []
    whole = U._open_pass
    monkeypatch.setattr(U, "_open_pass", lambda *a, **k: passes.append(1) or whole(*a, **k))
    monkeypatch.setattr(U, "OPEN_BYTES", 0)  # passes over all rows only
    rng = np.random.default_rng(2)
    U.lloyd(vec, {0: rng.random((3, 3)), 1: rng.random((2, 3))}, tol=0.0)
    assert len(passes) < 250


def test_rows_that_stay_with_their_centre():
    rng = np.random.default_rng(0)
    x, c, room = rng.normal(size=(5000, 3)) + 100, rng.normal(size=(4, 3)) + 100, 0.05
    best, loose = U._may_change(x, c, room)
    assert 0.02 < loose.mean() < 0.6
    for _ in range(20):
        step = rng.normal(size=c.shape)
        moved = c + step / np.linalg.norm(step, axis=1)[:, None] * room
        assert (U._sq_dists(x[~loose], moved).argmin(1) == best[~loose]).all()


def test_seeds_are_drawn_by_exact_distances():
    rng = np.random.default_rng(0)
    c = rng.normal(size=(40, 3)) * 5
    x = np.vstack([rng.normal(size=(900, 3)) * 5, c[::3]])
    place, d2 = U._nearest(x, c)
    np.testing.assert_allclose(d2, U._sq_dists(x, c).min(1))
    assert (d2[900:] == 0).all() and (place[900:] == np.arange(0, 40, 3)).all()


def _rows(spark, n=4000):
    return spark.range(n).select("id", F.rand(3).alias("a"), F.rand(4).alias("b")).withColumn("y", F.col("a") * 3 + F.sin(F.col("b") * 6) + 50).checkpoint()


def test_forest_grows_by_the_sums_of_its_cells(spark, monkeypatch, tmp_path):
    """a forest of many rows reads them a few times in all, not in a pass per level and group of trees."""
    from tablab.operators import forests as FO
    from tablab.operators import grid_forest as GF
    from tablab.operators import supervised as SV

    rows, params = _rows(spark), {"key": ["id"], "n_estimators": 12, "max_depth": 6}
    ask = lambda: SV.train_model(rows, ["a", "b"], "y", "random_forest", "regression", **params)
    plain = ask()
    monkeypatch.setattr(SV, "FOREST_CELLS", 1000)
    monkeypatch.setattr(GF, "GRID_SUMS", 5 * 32 * 32)  # five trees to a pass
    monkeypatch.setattr(SV, "join_forests", lambda *a: pytest.fail("grown row by row"))
    got = ask()
    forest = got.model.last_stage
    assert forest.getNumTrees == 12 and forest.numFeatures == 2 and max(t.depth for t in forest.trees) == 6
    assert len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 12
    shares = lambda r: [v["importance"] for v in SV.feature_importance(r).orderBy("feature").collect()]
    np.testing.assert_allclose(shares(got), shares(plain), atol=0.03)
    assert got.metrics().first()["r2"] > plain.metrics().first()["r2"] - 0.01 > 0.9
    assert FO.node_sizes(spark, forest).where("least_rows < 2").isEmpty()
    SV.save_model(got, str(tmp_path / "m"))
    again, _ = SV.load_model(spark, str(tmp_path / "m"))
    a, b = (m.transform(got.test).agg(F.sum("prediction")).first()[0] for m in (got.model, again))
    assert a == b


def test_a_tree_by_cells_is_the_tree_by_rows(spark):
    """Without a bootstrap the same splits and predictions as Spark ML's on the same boundaries."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from tablab.operators import grid_forest as GF

    rows = spark.range(3000).select(F.expr("double(id % 7)").alias("a"), F.expr("double(pmod(hash(id), 11))").alias("b"), F.rand(5).alias("e"))
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).select("features", (F.col("a") * F.col("b") + F.col("e")).alias("label")).checkpoint()
    forest = RandomForestRegressor(numTrees=1, maxDepth=5, featureSubsetStrategy="all", minInstancesPerNode=20, bootstrap=False, seed=1)
    mine, its = GF.fit(rows, forest, GF.bin_edges(rows, 2, 32), 1), forest.fit(rows)
    assert [len(e) for e in GF.bin_edges(rows, 2, 32)] == [6, 10]
    nodes = lambda m: m.trees[0].toDebugString.split("\n")[1:]
    cut = lambda lines: [line.split("Predict")[0] for line in lines]
    assert cut(nodes(mine)) == cut(nodes(its))
    a, b = ([r["prediction"] for r in m.transform(rows).select("prediction").collect()] for m in (mine, its))
    np.testing.assert_allclose(a, b)


def test_boundaries_of_many_and_few_values(spark):
    from pyspark.ml.feature import VectorAssembler

    from tablab.operators import grid_forest as GF

    rows = spark.range(5000).select(F.lit(3.0).alias("a"), F.expr("double(id % 32)").alias("b"), F.col("id").cast("double").alias("c"))
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).select("features")
    one, few, many = GF.bin_edges(rows, 3, 32)
    assert len(one) == 0 and few.tolist() == [i + 0.5 for i in range(31)]
    assert len(many) == 31 and np.abs(np.diff(many) - 5000 / 32).max() < 5


@pytest.mark.parametrize("eps,least", [(0.5, 6), (0.35, 4), (0.9, 40)])
def test_four_features_are_clustered_by_cells(spark, monkeypatch, eps, least):
    """no block of points is compared with all neighbouring blocks, and every point has the cluster that has them all compared."""
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(size=(250, 4)) * 0.25 + m for m in rng.normal(size=(6, 4)) * 1.2] + [rng.uniform(-3, 3, size=(300, 4)), np.ones((30, 4))])
    rows = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, a double, b double, c double, d double").checkpoint()
    near = U._sq_dists(x, x) <= eps * eps
    core = near.sum(1) >= least
    label, n = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        todo = [i] if label[i] < 0 else []
        while todo:
            j = todo.pop()
            if label[j] < 0:
                label[j] = n
                todo += np.flatnonzero(near[j] & core & (label < 0)).tolist()
        n = max(n, label[i] + 1)
    for i in np.flatnonzero(~core):
        mine = label[near[i] & core]
        label[i] = mine.min() if len(mine) else -1
    monkeypatch.setattr(U, "_cell_pairs", lambda *a: pytest.fail("blocks compared"))
    pts = U.prepare_points(rows, ["a", "b", "c", "d"], normalize=False, keep=["id"])
    got = U.dbscan(pts, eps, least, key="id").select("id", "cluster").orderBy("id").toPandas()
    assert n > 1 and (label < 0).any() and (got["cluster"].to_numpy() == label).all()


def test_exact_silhouette_copies_no_rows(spark, monkeypatch):
    """rows are compared where they are, block after block; the score is the definition's, among equal rows too."""
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(60, 5)) + 1000, np.repeat(rng.normal(size=(2, 5)) + 1000, 30, axis=0)])
    c = np.r_[rng.integers(0, 3, 60), np.tile([0, 1], 30)]
    d = np.sqrt(U._sq_dists(x, x))
    scores = []
    for i in range(len(x)):
        a = d[i][c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i][c == k].mean() for k in set(c) if k != c[i])
        scores.append((b - a) / max(a, b))
    rows = spark.createDataFrame([(i, list(map(float, v)), int(k)) for i, (v, k) in enumerate(zip(x, c))], "id long, f array<double>, cluster int")
    monkeypatch.setattr(U, "PAIR_BLOCK", 100)  # six blocks
    monkeypatch.setattr(U, "PAIR_TILE", 6)
    got = U.silhouette_euclidean(rows, "id", "f", "cluster", block_rows=7)
    assert got.first()[0] == pytest.approx(np.mean(scores), abs=1e-9)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().toString()


def test_distances_by_products_are_exact_where_rows_meet():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(50, 8)), rng.normal(size=(50, 8)) * 1e-5 + 3, [[np.nan] * 8], [[np.inf] + [0.0] * 7]])
    with np.errstate(invalid="ignore"):
        np.testing.assert_allclose(U._distances(x, x[::-1]), np.sqrt(U._sq_dists(x, x[::-1])), rtol=1e-8, atol=0)


def test_svr_pass_holds_few_mapped_rows(spark):
    """the loss and gradient of a pass are those of all rows at once, and one row of sums leaves a task."""
    from pyspark.ml.functions import array_to_vector

    from tablab.operators import svr

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(3000, 3)), rng.normal(size=3000)
    rff = {"w": rng.normal(size=(3, 40)).tolist(), "b": rng.normal(size=40).tolist()}
    vec = spark.createDataFrame([(list(map(float, a)), float(b)) for a, b in zip(x, y)], "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    w = rng.normal(size=41)
    loss, grad = svr._loss_grad(vec, w, 2.0, 0.1, 1e-3, rff)
    z = np.sqrt(2 / 40) * np.cos(x @ np.array(rff["w"]) + np.array(rff["b"]))
    f = lambda v: 2.0 * sum(0 if u <= 0 else u * u / 2e-3 if u <= 1e-3 else u - 5e-4 for u in np.abs(y - z @ v[:40] - v[40]) - 0.1) + 0.5 * v[:40] @ v[:40]
    assert loss == pytest.approx(f(w))
    for j in (0, 7, 40):
        e = np.eye(41)[j] * 1e-6
        assert grad[j] == pytest.approx((f(w + e) - f(w - e)) / 2e-6, rel=1e-3, abs=1e-2)
