"""Cases the given tables do not hold: repeated keys and rows, hot cells, odd labels, late bytes, typed constants."""

import datetime
import decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablab.functions.cumulative import running_sums
from tablab.operators import cluster as U
from tablab.operators import neighbors as NB
from tablab.operators import profile as P
from tablab.operators import quantiles as Q
from tablab.operators import split as S
from tablab.operators import supervised as SV
from tablab.plans.recipe import Recipe
from tablab.session import ensure_checkpoint_dir
from tablab.sources.delimited import infer_numeric, normalize_missing, read_delimited


def test_knn_repeated_and_colliding_keys(spark):
    train = spark.createDataFrame([(i, [float(i)], int(i >= 10)) for i in range(20)], "id long, x array<double>, label int")
    # keys 30831 and 96789 share their 32-bit hash under one seed; two rows share key and point
    test = spark.createDataFrame([(30831, [0.0]), (96789, [19.0]), (7, [19.0]), (7, [19.0]), (7, [0.0])], "id long, x array<double>")
    out = NB.knn_classify(train, test, "id", "x", "label", 3, cell_target=4, query_target=2)
    assert sorted((r.id, r.x[0], r.prediction) for r in out.collect()) == [
        (7, 0.0, 0), (7, 19.0, 1), (7, 19.0, 1), (30831, 0.0, 0), (96789, 19.0, 1)]
    neigh = NB.knn_neighbors(train, test, ["id"], ["id"], "x", "label", 2)
    assert neigh.count() == 10
    assert NB.knn_classify(train.limit(0), test, "id", "x", "label", 3).where("prediction is null").count() == 5


def test_kmeans_of_repeated_rows(spark):
    rows = spark.range(75_000).select((F.col("id") % 3 * 10.0).alias("a"), F.lit(1.0).alias("b"))
    pts = U.prepare_points(rows, ["a", "b"], normalize=False)
    res = U.kmeans(pts, 3, n_init=2)
    assert res.inertia == 0 and [c[0] for c in res.centers] == [0.0, 10.0, 20.0]
    assert len(U.kmeans(pts, 5, n_init=1).centers) == 5  # more clusters than points
    with pytest.raises(ValueError):
        U.kmeans(U.prepare_points(rows.limit(2), ["a"], normalize=False), 3)


def brute_dbscan(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    n = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = n
            while todo:
                j = todo.pop()
                for k in np.flatnonzero(near[j] & core & (label < 0)):
                    label[k] = n
                    todo.append(k)
            n += 1
    for i in np.flatnonzero(~core):
        touching = label[near[i] & core]
        label[i] = touching.min() if len(touching) else -1
    return label


@pytest.mark.parametrize("d", [1, 2, 3, 4, 6])
def test_dbscan_against_brute_force(spark, d, monkeypatch):
    monkeypatch.setattr(U, "BLOCK_POINTS", 16)
    rng = np.random.default_rng(d)
    x = np.vstack([rng.normal(0, 0.15, (60, d)), rng.normal(1.2, 0.25, (60, d)), rng.uniform(-2, 3, (60, d)), np.zeros((25, d))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"x{j} double" for j in range(d)))
    pts = U.prepare_points(df, [f"x{j}" for j in range(d)], normalize=False, keep=["id"])
    got = U.dbscan(pts, eps=0.45, min_samples=5, key="id").orderBy("id").collect()
    assert [r.cluster for r in got] == brute_dbscan(x, 0.45, 5).tolist()


@pytest.mark.parametrize("d", [2, 4])
def test_dbscan_hot_cell(spark, d):
    """One cell with most rows: twenty thousand copies, a far pair, a neighbour."""
    cols = [F.when(F.col("id") < 20_000, 0.0).when(F.col("id") < 20_002, 50.0).otherwise(0.4).alias(f"x{j}") for j in range(d)]
    df = spark.range(20_003).select("id", *cols)
    out = U.dbscan(U.prepare_points(df, [f"x{j}" for j in range(d)], normalize=False, keep=["id"]), eps=1.0, min_samples=4, key="id")
    assert {r.cluster: r["count"] for r in out.groupBy("cluster").count().collect()} == {0: 20_001, -1: 2}


def test_quantiles_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(Q, "VALUES", 40)  # many narrowing steps
    monkeypatch.setattr(Q, "PARTS", 16)
    monkeypatch.setattr(Q, "FEW", 4)
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=30_000), rng.integers(0, 4, 30_000), [1e12, -1e12]])
    df = spark.createDataFrame([(float(v), int(i % 3) if i % 11 else None) for i, v in enumerate(x)], "v double, g int").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    assert Q.column_quantiles(df, ["v"], probs)["v"] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12)
    g = np.array([i % 3 if i % 11 else -1 for i in range(len(x))])
    got = {(r.g if r.g is not None else -1, r._pi): r.q for r in Q.quantiles_long(df, ["g"], "v", probs).collect()}
    for k in (-1, 0, 1, 2):
        assert [got[k, i] for i in range(len(probs))] == pytest.approx(np.quantile(x[g == k], probs).tolist(), rel=1e-12)
    empty = df.where("v is null")
    assert Q.column_quantiles(empty, ["v"], [0.5])["v"] == [None] and Q.quantiles_long(empty, ["g"], "v", [0.5]).count() == 0


def test_folds_and_running_sums_keep_null_classes(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(40)], "id long, y int")
    out = S.stratified_kfold(df, "id", "y", 4)
    assert out.count() == 40 and out.where("y is null").groupBy("fold").count().count() == 4
    sums = running_sums(df.withColumn("one", F.lit(1)), "id", ["one"], ["y"])
    assert sums.where("y is null").agg(F.max("cum_one")).first()[0] == 10
    train, test = S.train_test_split(df, "id", 0.25, exact=True)
    assert (train.count(), test.count()) == (30, 10)


@pytest.mark.parametrize("model, classes", [
    ("logistic", (-1, 1)), ("logistic", ("a", "b", "c")), ("svm", (1, 2)), ("svm", ("a", "b", "c")), ("knn", (2, 5, 9)),
    ("knn", (1, 2)), ("random_forest", (1000, 2000)), ("random_forest", ("a", "b", "c")),
])
def test_any_class_labels(spark, tmp_path, model, classes):
    rows = [(float(i % len(classes)) + (i % 7) * 0.01, classes[i % len(classes)]) for i in range(90)]
    df = spark.createDataFrame(rows, ["f", "t"])
    params = {"n_estimators": 5, "max_depth": 4} if model == "random_forest" else {"kernel": "linear", "max_iter": 10} if model == "svm" else {}
    res = SV.train_model(df, ["f"], "t", model=model, task="classification", **params)  # no key given
    got = res.predictions.select("actual", "predicted").collect()
    assert got and {type(r.predicted) for r in got} <= {type(classes[0])} and {r.predicted for r in got} <= set(classes)
    if model != "svm" or len(classes) == 2:
        assert sum(r.actual == r.predicted for r in got) >= 0.9 * len(got)
    assert {r.actual for r in SV.confusion(res).collect()} <= set(classes)
    curves = SV.roc_curves(res).select("cls", "class_value").distinct().collect()
    assert len(curves) == (1 if len(classes) == 2 else len(classes)) and {r.class_value for r in curves} <= set(map(str, classes))
    if classes != (2, 5, 9):
        SV.save_model(res, str(tmp_path / "m"))
        back, _ = SV.load_model(spark, str(tmp_path / "m"))
        both = back.transform(res.test)
        assert sorted((r.f, r.prediction) for r in both.collect()) == sorted((r.f, r.prediction) for r in res.predictions.collect())
        if model != "random_forest":
            shares = [list(r[0]) for r in both.select("probability").collect()]
            assert all(abs(sum(s) - 1) < 1e-6 for s in shares)


def test_delimited_late_bytes_and_missing_words(spark, tmp_path):
    late = tmp_path / "late.csv"
    late.write_bytes(("id,name\n" + "".join(f"{i},plain\n" for i in range(400)) + '400,"caf\xe9\nbar"\n').encode("latin-1"))
    df = read_delimited(spark, str(late))
    assert df.count() == 401 and dict(df.dtypes)["id"] == "bigint"
    assert df.where("id = 400").first().name == "caf\xe9\nbar"
    words = tmp_path / "words.csv"
    words.write_text("a,b,c\n1,NaN,x\nNA,2.5,null\n N/A ,?,None\n4,1,nan\n")
    rows = read_delimited(spark, str(words))
    assert dict(rows.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([(1, None, "x"), (None, 2.5, None), (None, None, None), (4, 1.0, None)], key=str)
    messy = spark.createDataFrame([("1", "?", float("nan")), ("2.5", "y", 1.0), ("NA", "", 2.0)], "n string, s string, f double")
    clean = infer_numeric(normalize_missing(messy))
    assert dict(clean.dtypes) == {"n": "double", "s": "string", "f": "double"}
    assert clean.where("f is null").count() == 1 and clean.where("s is null").count() == 2


def test_recipe_keeps_typed_constants(spark):
    rows = [(datetime.date(2024, 1, 1), decimal.Decimal("1.50")), (datetime.date(2024, 1, 1), decimal.Decimal("1.50")), (None, None)]
    df = spark.createDataFrame(rows, "d date, m decimal(10,2)")
    fitted = Recipe().add("fill_nulls", c="d", strategy="mode").add("fill_nulls", c="m", strategy="mode").fit(df)
    again = Recipe.from_json(fitted.to_json())
    assert again.apply(df).distinct().collect() == [(datetime.date(2024, 1, 1), decimal.Decimal("1.50"))]


def test_overview_describe_and_correlation(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "b", None), (3, "b", 5.0), (3, None, 5.0)], "i int, s string, f double")
    exact, rough = P.column_overview(df), P.column_overview(df, approx=True)
    assert sorted(exact.collect()) == sorted(rough.collect())
    rows = {r.column_name: r for r in P.describe(df).collect()}
    assert list(rows["s"])[1:5] == [3, 2, "b", 2] and rows["f"].mean == 4.0 and [r.position for r in rows.values()] is not None
    assert {r.column_name: r["count"] for r in P.describe(df, approx=True).collect()} == {"i": 4, "s": 3, "f": 3}
    wide = spark.range(200).select(*[(F.sin(F.col("id") * (j + 1)) + j).alias(f"c{j}") for j in range(60)], F.lit(3.0).alias("flat"))
    got = {(r.row_name, r.col_name): r["corr"] for r in P.correlation_matrix(wide).collect()}
    want = np.corrcoef(wide.drop("flat").toPandas().to_numpy().T)
    assert got["flat", "c1"] is None and got["flat", "flat"] is None
    assert all(abs(got[f"c{i}", f"c{j}"] - want[i, j]) < 1e-9 for i in range(60) for j in range(60))


def test_cluster_without_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(ValueError):
        ensure_checkpoint_dir(Session())
