"""Rows by position, looking ahead over ranges, folds from one pass, class tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablab.functions.cumulative import with_next
from tablab.operators import clean as C
from tablab.operators import metrics as M
from tablab.operators import supervised as V
from tablab.operators import transform as X
from tablab.sources import tables as TB


@pytest.mark.parametrize("split", ["1g", "40k", "9k"])
def test_position_does_not_depend_on_the_partitions(spark, tmp_path, split):
    rows = [(i, i * 7919 % 13, f"text {i} " * 20) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, k long, t string")
    for part in range(3):
        df.where(f"id between {part * 2000} and {part * 2000 + 1999}").coalesce(1).sortWithinPartitions("id").write.option("parquet.block.size", 20_000).mode(
            "append").parquet(f"{tmp_path}/t/p={part}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = TB.read_positioned(spark, f"{tmp_path}/t")
        assert [r["id"] for r in TB.head(spark, f"{tmp_path}/t", 7).collect()] == list(range(7))
        first = C.first_of_duplicates(got, ["k"])
        want = {}
        for i, k, _ in rows:
            want.setdefault(k, i)
        assert {r["k"]: r["id"] for r in first.collect()} == want and first.columns == got.columns
        assert C.first_of_duplicates(got).count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.createDataFrame([(1,)], "Position int").write.parquet(f"{tmp_path}/clash")
    with pytest.raises(ValueError):
        TB.read_positioned(spark, f"{tmp_path}/clash")


def test_next_row_over_ranges(spark):
    rng = np.random.default_rng(0)
    rows = [(g, float(s), int(s * 10)) for g, n in (("a", 300), (None, 40), ("b", 1)) for s in np.unique(rng.random(n).round(4))]
    df = spark.createDataFrame(rows, "g string, s double, v long")
    for keys in (["g"], []):
        use = df if keys else df.where("g = 'a'")
        want = {}
        for g in {r[0] for r in rows} if keys else {"a"}:
            own = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1])
            want |= {(g, r[1]): (own[i + 1][2] if i + 1 < len(own) else None, i == 0) for i, r in enumerate(own)}
        for ranges in (2, 50, 1000):
            got = with_next(use, "s", ["v"], keys, descending=True, ranges=ranges)
            assert {(r["g"], r["s"]): (r["next_v"], r["is_first"]) for r in got.collect()} == want


def test_roc_keeps_its_area(spark):
    rng = np.random.default_rng(5)
    rows = [(int(y), round(float(y * 0.4 + rng.random()), 2)) for y in rng.integers(0, 2, 900)] + [(0, 3 + i / 100) for i in range(50)]
    df = spark.createDataFrame(rows, "label int, score double")
    curves = {d: sorted((r["fpr"], r["tpr"], -r["threshold"]) for r in M.roc_curve(df, drop_intermediate=d).collect()) for d in (False, True)}
    area = {d: np.trapezoid([t for _, t, _ in c], [f for f, _, _ in c]) for d, c in curves.items()}
    assert area[True] == pytest.approx(area[False]) and len(curves[True]) < len(curves[False]) - 40
    assert set(curves[True]) <= set(curves[False]) and curves[True][0] == curves[False][0] and curves[True][-1] == curves[False][-1]


@pytest.mark.parametrize("model", ["linear", "ridge"])
def test_folds_by_subtraction_equal_fits(spark, model):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(1e6 + b), float(2 * a - 3 * b + e)) for i, (a, b, e) in enumerate(zip(rng.random(400), rng.random(400) * 50, rng.normal(size=400)))]
    prep = V.prepare_xy(spark.createDataFrame(rows, "id long, a double, b double, y double"), ["a", "b"], "y", ["id"], "regression")
    got = {r["fold"]: r["score"] for r in V.cross_validate(prep, model, 4, alpha=2.0).collect()}
    folded = V.S.kfold(prep.df, prep.key, 4, 42)
    for f in range(4):
        fit = V._fit_model(prep, V.ModelSpec(model, "regression", {"alpha": 2.0}), folded.where(F.col("fold") != f), False, 42)
        assert got[f] == pytest.approx(M.regression_metrics(fit.transform(folded.where(F.col("fold") == f))).first()["r2"], abs=1e-6)
    empty = V.Prepared(prep.df.limit(0), prep.features, "y", "regression", ["id"])
    assert [r["score"] for r in V.cross_validate(empty, model, 3).collect()] == [None] * 3


def test_class_tables(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(X, "MAX_LISTED", 50)
    monkeypatch.setattr(X, "MAX_SCHEMA", 60)
    df = spark.createDataFrame([(i, f"v{i * 7919 % 997:03d}" if i % 50 else None, i % 2) for i in range(3000)], "value long, c string, y int")
    params = X.fit_label_encode(df, "c")
    assert set(params) == {"table"}
    classes = sorted({r["c"] if r["c"] is not None else "nan" for r in df.collect()})
    got = {r["value"]: r["c"] for r in X.apply_label_encode(df, "c", params).collect()}
    assert got == {r["value"]: classes.index(r["c"] if r["c"] is not None else "nan") for r in df.collect()}
    unseen = X.apply_label_encode(spark.createDataFrame([("new",)], "c string"), "c", params)
    assert unseen.first()["c"] is None
    with pytest.raises(ValueError):
        X.fit_one_hot(df, "c")
    with pytest.raises(ValueError):
        X.fit_classes(df, "c")
    few = X.fit_label_encode(df.where("value < 20"), "c")
    assert few["classes"] == sorted(few["classes"]) and "table" not in few
    # the table travels with a saved model
    res = V.train_model(df.na.drop(), ["c"], "y", "logistic", key=["value"])
    V.save_model(res, f"{tmp_path}/m")
    model, meta = V.load_model(spark, f"{tmp_path}/m")
    assert meta["feature_codes"]["c"]["table"].startswith(f"{tmp_path}/m")
    again = model.transform(V.encode_for_model(df.na.drop().select("value", "c"), meta))
    mine = {r["value"]: r["prediction"] for r in again.collect()}
    assert all(mine[r["value"]] == r["prediction"] for r in res.predictions.collect())
