"""Steps that must not grow faster than their input; every test builds its own rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablab.operators import cluster as U


def _plane(spark, n=20_000):
    return spark.range(n).select(F.rand(1).alias("x0"), F.rand(2).alias("x1")).checkpoint()


def test_blocks_of_neighbours_give_the_sums_of_the_rows(spark):
    vec, rng = _plane(spark), np.random.default_rng(0)
    cents = {0: rng.random((3, 2)), 1: rng.random((5, 2)), 2: np.array([[0.25, 0.5], [0.75, 0.5], [0.75, 0.5]])}
    rows, blocks = U._lloyd_pass(vec, cents), U._block_pass(U._blocks_of_rows(vec), cents)
    for i in cents:
        for a, b in zip(rows[i], blocks[i]):
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9)
    assert rows[2][1][2] == 0  # of equal centres the first has the rows


def test_most_blocks_are_settled_without_their_rows(spark):
    blocks = U._blocks_of_rows(_plane(spark)).toPandas()
    assert blocks["n"].sum() == 20_000
    won = U._settled(np.vstack(blocks["lo"]), np.vstack(blocks["hi"]), np.array([[[0.2, 0.2], [0.8, 0.8]]]))
    assert (won[:, 0] >= 0).mean() > 0.5


def test_blocks_take_constant_and_single_columns(spark):
    vec = spark.range(700).select(F.lit(3.0).alias("x0"), (F.col("id") % 7).cast("double").alias("x1"))
    got = U._block_pass(U._blocks_of_rows(vec), {0: np.array([[3.0, 0.0], [3.0, 6.0]])})[0]
    assert got[1].tolist() == [400.0, 300.0] and got[2] == pytest.approx(100 * (0 + 1 + 4 + 9 + 4 + 1 + 0))


def _rows(spark, n=1500):
    return spark.range(n).select("id", F.rand(3).alias("a"), F.rand(4).alias("b")).withColumn("y", F.col("a") * 3 + F.sin(F.col("b") * 6)).checkpoint()


def test_forest_in_groups_of_trees(spark, monkeypatch):
    from tablab.operators import forests as FO
    from tablab.operators import supervised as SV

    monkeypatch.setattr(SV, "FOREST_CELLS", 4000)
    got = SV.train_model(_rows(spark), ["a", "b"], "y", "random_forest", "regression", key=["id"], n_estimators=10, max_depth=4)
    forest = got.model.last_stage
    assert forest.getNumTrees == 10 == FO.node_sizes(spark, forest).count()
    assert len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) == 10  # no tree grown twice
    assert sum(r["importance"] for r in SV.feature_importance(got).collect()) == pytest.approx(1.0)
    assert got.metrics().first()["r2"] > 0.8


def test_svr_stores_no_fourier_features(spark, monkeypatch):
    from tablab.operators import supervised as SV
    from tablab.operators import svr

    seen = []
    whole = svr.fit_linear_svr
    monkeypatch.setattr(svr, "fit_linear_svr", lambda vec, **kw: seen.append((vec.first()["features"].size, len(kw["rff"]["b"]))) or whole(vec, **kw))
    rows = _rows(spark)
    got = SV.train_model(rows, ["a", "b"], "y", "svr", "regression", key=["id"])
    assert seen == [(2, SV.RFF_COMPONENTS)]
    again = whole(got.model.vectors(got.train).select("features", "label"))  # fitted on stored features
    np.testing.assert_allclose(again["w"], got.model.svr["w"], rtol=1e-4, atol=1e-4)


def test_neighbours_close_together_far_from_zero():
    import pandas as pd

    from tablab.operators.neighbors import _block_topk

    rng = np.random.default_rng(0)
    for x in (1e6 + rng.normal(size=(300, 40)), rng.integers(0, 3, (300, 3)).astype(float), np.r_[rng.normal(size=(299, 4)), [[np.inf, 0, 0, 0]]]):
        q = x[::7] + 0.25
        got = _block_topk(4, ["_t0"])(pd.DataFrame({"_qid": np.arange(len(q)), "_q": list(q)}), pd.DataFrame({"_t0": np.arange(300), "_x": list(x), "_y": 0}))
        acc = np.zeros((len(q), 300))
        with np.errstate(invalid="ignore"):
            for j in range(x.shape[1]):
                acc += (q[:, j][:, None] - x[:, j][None, :]) ** 2
        d = np.sqrt(acc)
        for i, rows in got.groupby("_qid"):
            if i == len(q) - 1 and not np.isfinite(d[i]).all():
                continue
            want = np.argsort(d[i], kind="stable")[:4]
            assert rows["_t0"].tolist() == want.tolist() and rows["_d"].tolist() == d[i][want].tolist()


def test_a_pair_across_a_gap_is_found_without_comparing_all(monkeypatch):
    rng, compared = np.random.default_rng(0), []
    whole = U._sq_dists
    monkeypatch.setattr(U, "_sq_dists", lambda a, b: compared.append(len(a) * len(b)) or whole(a, b))
    left, right = rng.random((20_000, 2)), rng.random((20_000, 2)) + [1.01, 0.0]
    true = np.sqrt(((left[left[:, 0].argsort()[-2000:]][:, None] - right[right[:, 0].argsort()[:2000]][None]) ** 2).sum(2).min())
    assert U._any_pair(left, right, (true * 1.000001) ** 2) and not U._any_pair(left, right, (true * 0.999999) ** 2)
    assert sum(compared) < 20_000**2 / 20


def test_fourier_features_are_mapped_few_rows_at_a_time():
    """what a Python worker holds does not grow with the rows of an Arrow batch."""
    import tracemalloc

    import pandas as pd

    from tablab.operators import supervised as SV

    rng = np.random.default_rng(0)
    x, w, b = rng.normal(size=(10_000, 8)), rng.normal(size=(8, 256)), rng.normal(size=256)
    xs = pd.Series(list(x))
    tracemalloc.start()
    sizes = [len(part) for part in SV._fourier(iter([xs]), w, b)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 10_000 and peak < 10_000 * 256 * 8 / 2
    got = np.vstack([np.vstack(part.to_numpy()) for part in SV._fourier(iter([xs, xs[:0], xs[:3]]), w, b)])
    np.testing.assert_allclose(got, np.sqrt(2 / 256) * np.cos(np.vstack([x, x[:3]]) @ w + b), rtol=1e-12, atol=1e-12)


def test_kernel_passes_join_their_rows_at_once():
    """the rows of a batch as one matrix; uneven rows are an error."""
    import pandas as pd

    from tablab.operators import kernels as K

    x = np.arange(12.0).reshape(6, 2)
    assert np.array_equal(K._rows_of(pd.Series(list(x))), x) and np.array_equal(K._rows_of(pd.Series(list(x))[2:5]), x[2:5])
    with pytest.raises(ValueError):
        K._rows_of(pd.Series([np.ones(1), np.ones(2)]))


def test_rows_of_a_hot_facet_stay_where_they_are(spark, monkeypatch):
    """a facet with most of the rows is not shuffled into one task; small ones and null count as before."""
    from tablab.operators import reduction as R

    facet = F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, F.concat(F.lit("f"), F.floor(F.col("id") / 20)))
    rows = spark.range(20_000, numPartitions=8).select("id", (F.col("id") * 7 % 1000).alias("x"), facet.alias("facet")).checkpoint()
    share, whole = [], R._matched

    def spy(many, facts, *rest):
        out = whole(many, facts, *rest)
        n = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        share.append(max(n) / sum(n))
        return out

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(R, "_matched", spy)
        points = R.sample_points(rows, ["id", "x"], 50, ["facet"], key=["id"])
        assert share[0] < 0.5
        share.clear()
        line = R.line_envelope(rows, "id", "x", ["facet"], 40)
        assert share[0] < 0.5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    monkeypatch.undo()
    table = rows.toPandas()
    table["h"] = [r.h for r in rows.select(R.key_hash(["id"], 42).alias("h")).collect()]
    want = table.sort_values(["h", "id"]).groupby("facet", dropna=False).head(50)
    assert sorted(r.id for r in points.collect()) == sorted(want["id"])
    ends = table.groupby("facet", dropna=False)["id"].agg(["min", "max"])
    assert {v for pair in ends.values.tolist() for v in pair} <= {r.id for r in line.collect()}


def test_forest_tasks_hold_few_rows(spark, monkeypatch):
    """the rows of one large split are dealt out to tasks that can hold them; small tables stay as they are."""
    from tablab.operators import supervised as SV

    rows, seen, whole = _rows(spark).coalesce(1), [], SV._fit_stages
    monkeypatch.setattr(SV, "_fit_stages", lambda spec, n, stats, seed, vec: seen.append((vec.rdd.getNumPartitions(), n)) or whole(spec, n, stats, seed, vec))
    fit = lambda: SV.train_model(rows, ["a", "b"], "y", "random_forest", "regression", key=["id"], n_estimators=4, max_depth=4)
    fit()
    monkeypatch.setattr(SV, "FOREST_TASK_BYTES", 30_000)
    got = fit()
    (one, n), (many, again) = seen
    assert one == 1 and n == again > 1000 and n / many * (250 + 8 + 48) <= 30_000
    assert got.metrics().first()["r2"] > 0.8
