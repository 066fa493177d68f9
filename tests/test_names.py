"""Columns may have any name, also those that an operator uses on its way."""

import math

import pytest
from pyspark.sql import functions as F

from tablab.operators import charts as G
from tablab.operators import clean as C
from tablab.operators import cluster as U
from tablab.operators import neighbors as N
from tablab.operators import profile as P
from tablab.operators import reduction as R
from tablab.operators import split as S
from tablab.operators import supervised as M
from tablab.operators import transform as X

NAMES = ["label", "code", "cluster", "features", "prediction", "probability", "q1", "median", "_v", "_n", "_rank", "_h", "_s", "_cl", "_off", "_rn", "_all",
         "_qid", "_pid", "is_test", "__h", "__rank", "__qid", "__value", "__code", "_lab_pid", "count", "value", "q", "_group", "key0"]
N_ROWS = 60


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(N_ROWS).select("id", (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("c"), (F.col("id") % 2).alias("y"))
    return rows.select("*", *[(F.col("id") * 10 + i).alias(n) for i, n in enumerate(NAMES)]).cache()


def same(table, out, but=()):
    """Every column that the operator does not replace comes back unchanged, row by row."""
    kept = [n for n in NAMES if n not in but]
    assert out.columns.count("id") == 1 and all(out.columns.count(n) == 1 for n in out.columns)
    want = {r["id"]: tuple(r[n] for n in kept) for r in table.collect()}
    got = [(r["id"], tuple(r[n] for n in kept)) for r in out.collect()]
    assert len(got) == len(want) and dict(got) == want


def test_transforms_and_splits_keep_all_columns(table):
    same(table, X.label_encode(table, "c"))
    same(table, X.one_hot(table, "c"))
    same(table, X.apply_scale(table, X.fit_scale(table, ["x"])))
    same(table, S.stratified_kfold(table, "id", "y"))
    same(table, S.kfold(table, "id"))
    same(table, S.with_exact_test_flag(table, "id"), ["is_test"])
    train, test = S.train_test_split(table, "id", exact=True)
    same(table, train.unionByName(test))
    assert test.count() == math.ceil(N_ROWS * 0.2)
    same(table, C.drop_duplicates(table))


@pytest.mark.parametrize("name", ["label", "q1", "_v", "_n", "_rank", "value", "key0"])
def test_group_columns_of_any_name(table, name):
    by = table.withColumn(name, F.col("c"))
    plain = table.select(F.col("c").alias("g"), "x")
    for fn in ("median", "mean"):
        got = sorted(map(tuple, P.group_agg(by, name, "x", fn).collect()))
        assert got == sorted(map(tuple, P.group_agg(plain, "g", "x", fn).collect()))
    box = G.box_data(by, name, "x")
    assert len(set(box.columns)) == len(box.columns)
    assert sorted(map(tuple, box.collect())) == sorted(map(tuple, G.box_data(plain, "g", "x").collect()))
    assert R.line_envelope(by, "id", "x", [name], 8).count() <= 24


def test_neighbours_and_clusters(table, spark):
    train = table.select("id", "x", F.col("y").alias("label"))
    out = N.knn_classify(train, table, "id", ["x"], "label", 3, classes=[0, 1])
    same(table, out, ["prediction", "probability"])
    near = N.knn_neighbors(train, table, ["id"], ["id", "_qid"], ["x"], "label", 2)
    assert near.count() == 2 * N_ROWS
    for key in (None, "id"):
        found = U.dbscan(U.prepare_points(table, ["x"], False, [c for c in table.columns if c not in ("x", "features")]), 0.5, 3, key)
        same(table, found, ["cluster", "features"])
        assert {r["cluster"] for r in found.collect()} == set(range(7))


def test_models_name_a_clash_and_split_repeated_rows(table, spark):
    assert M.train_model(table, ["x"], "y", "logistic", key=["id"]).predictions.count() > 0
    for taken in ("label", "features", "prediction"):
        with pytest.raises(ValueError, match=taken):
            M.prepare_xy(table, ["x"], "y", [taken])
        with pytest.raises(ValueError, match=taken):
            M.prepare_xy(table, ["x", taken], "y", ["id"])
    assert M.prepare_xy(table, ["x"], "label", ["id"], "regression").df.columns == ["id", "x", "label"]
    two = spark.createDataFrame([(float(i % 2), float(i % 2)) for i in range(400)], "x double, y double")
    prep = M.prepare_xy(two, ["x"], "y", task="regression")
    train, test = S.train_test_split(prep.df, prep.key)
    assert train.count() + test.count() == 400 and 50 <= test.count() <= 110
    assert test.where("x = 0").count() > 10 and test.where("x = 1").count() > 10
    parts = [sorted(map(tuple, S.train_test_split(M.prepare_xy(two.repartition(n), ["x"], "y", task="regression").df, prep.key)[1].select("x").collect())) for n in (1, 7)]
    assert parts[0] == parts[1]


def test_odd_values(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (math.inf, 3.0, 5.0), (2.0, 5.0, 2.0), (3.0, None, 7.0)], "x double, y double, z double")
    got = {(r.row_name, r.col_name): r["corr"] for r in P.correlation_matrix(df).collect()}
    assert got[("x", "x")] is None and got[("x", "y")] is None and got[("z", "z")] == 1.0 and got[("y", "z")] == pytest.approx(3 / math.sqrt(42 * 78))
    # the infinity stands in a row that the pair leaves out
    gap = spark.createDataFrame([(1.0, 2.0), (math.inf, None), (2.0, 5.0), (4.0, 6.0)], "x double, y double")
    assert {(r.row_name, r.col_name): r["corr"] for r in P.correlation_matrix(gap).collect()}[("x", "y")] == pytest.approx(51 / math.sqrt(42 * 78))
    assert P.describe(spark.range(3).select()).count() == 0
    clash = spark.createDataFrame([("a", 1), ("A", 2)], "c string, c_a int")
    assert X.one_hot(clash, "c").columns == ["c_a", "c_A_1", "c_a_2"]
