import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablab.operators import cluster as U
from tablab.operators import supervised as SV
from tablab.plans.recipe import Recipe
from tablab.sources.delimited import read_delimited, write_delimited
from tablab.streaming import apply_recipe_stream, read_stream


def _frame(spark):
    rows = [(i, float(i % 7) if i % 5 else None, ["x", "y", "z"][i % 3], float(i)) for i in range(1, 41)]
    return spark.createDataFrame(rows, "id long, a double, c string, v double")


def test_recipe_fit_apply_undo_json(spark):
    df = _frame(spark)
    r = Recipe().add("fill_nulls", c="a", strategy="median").add("one_hot", c="c").add("scale", cols=["v"], method="minmax")
    fitted = r.fit(df)
    out = fitted.apply(df)
    assert out.columns == ["id", "a", "v", "c_x", "c_y", "c_z"]
    assert out.where(F.col("a").isNull()).count() == 0
    assert out.agg(F.min("v"), F.max("v")).first() == (0.0, 1.0)
    again = Recipe.from_json(fitted.to_json())
    assert sorted(again.apply(df).collect()) == sorted(out.collect())
    assert len(fitted.undo().steps) == 2 and fitted.reset().steps == []
    assert len(fitted.script()) == 3


def test_failed_step_not_recorded(spark):
    df = _frame(spark)
    r = Recipe().add("fill_nulls", c="a", strategy="mean")
    r2, cur = r.fit(df), None
    with pytest.raises(Exception):
        r2.step(r2.apply(df), "fill_nulls", c="c", strategy="mean")  # text column: mean is invalid
    assert len(r2.steps) == 1


def test_recipe_on_stream(spark, tmp_path):
    df = _frame(spark)
    src = str(tmp_path / "in")
    df.write.parquet(src)
    fitted = Recipe().add("fill_nulls", c="a", strategy="mean").add("label_encode", c="c").fit(df)
    stream = read_stream(spark, src, df.schema)
    q = apply_recipe_stream(fitted, stream).writeStream.format("memory").queryName("recipe_out").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(spark.sql("SELECT * FROM recipe_out").collect())
    assert got == sorted(fitted.apply(df).collect())


def test_delimited_fixtures(spark, tmp_path):
    files = {
        "comma.csv": b"a,b\n1,2\n3,4\n",
        "semicolon_decimal.csv": b"n;v\n1;1,5\n2;\n",
        "tab.tsv": b"a\tb\n1\t2.5\n",
        "latin1.csv": "k,name\n1,café\n".encode("latin-1"),
        "question_mark.csv": b"id,v\n1,3\n2,?\n",
        "one_column.csv": b"only\n1\n2\n",
        "quoted.csv": b'a,b\n1,"x,y"\n2,"two\nlines"\n',
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    p = lambda n: str(tmp_path / n)
    assert read_delimited(spark, p("comma.csv")).collect()[0].asDict() == {"a": 1, "b": 2}
    sd = read_delimited(spark, p("semicolon_decimal.csv"))
    assert dict(sd.dtypes)["v"] == "double" and [r["v"] for r in sd.orderBy("n").collect()] == [1.5, None]
    assert read_delimited(spark, p("tab.tsv")).first()["b"] == 2.5
    assert read_delimited(spark, p("latin1.csv")).first()["name"] == "café"
    qm = read_delimited(spark, p("question_mark.csv"))
    assert dict(qm.dtypes)["v"] == "bigint" and qm.orderBy("id").collect()[1]["v"] is None
    assert read_delimited(spark, p("one_column.csv")).columns == ["only"]
    qt = read_delimited(spark, p("quoted.csv")).orderBy("a").collect()
    assert qt[0]["b"] == "x,y" and qt[1]["b"] == "two\nlines"
    out = str(tmp_path / "out")
    write_delimited(sd, out)
    back = read_delimited(spark, out)
    assert sorted(back.collect()) == sorted(read_delimited(spark, out).collect())


def test_ols_and_ridge_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 3 + x @ np.array([2.0, -1.5]) + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(i, float(a), float(b), float(t)) for i, ((a, b), t) in enumerate(zip(x, y))],
                               "id long, a double, b double, y double")
    prep = SV.prepare_xy(df, ["a", "b"], "y", key=["id"], task="regression")
    for model, alpha in [("linear", 0.0), ("ridge", 1.0)]:
        fm = SV._fit_model(prep, SV.ModelSpec(model, "regression", {"alpha": alpha}), prep.df, normalize=False, seed=42)
        lm = fm.last_stage
        xc, yc = x - x.mean(0), y - y.mean()
        w = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
        assert lm.coefficients.toArray() == pytest.approx(w, rel=1e-6)
        assert lm.intercept == pytest.approx(y.mean() - x.mean(0) @ w, rel=1e-6)


def test_forest_importance_and_save_load(spark, tmp_path):
    rows = [(i, float(i % 10), float(i % 3), float((i % 10) > 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, t double")
    res = SV.train_model(df, ["a", "b"], "t", model="random_forest", task="classification", key=["id"], n_estimators=10)
    imp = [r["importance"] for r in SV.feature_importance(res).collect()]
    assert sum(imp) == pytest.approx(1.0)
    path = str(tmp_path / "model")
    SV.save_model(res, path)
    fm, meta = SV.load_model(spark, path)
    assert meta["features"] == ["a", "b"]
    a = sorted(r["prediction"] for r in res.predictions.collect())
    b = sorted(r["prediction"] for r in fm.transform(res.test).collect())
    assert a == b


def test_kmeans_and_pca(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 0.2, (50, 2)), rng.normal(5, 0.2, (50, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    pts = U.prepare_points(df, ["a", "b"], normalize=False, keep=["id"])
    res = U.kmeans(pts, 2, n_init=3)
    lab = {r["id"]: r["cluster"] for r in res.assign(pts.df).collect()}
    assert len({lab[i] for i in range(50)}) == 1 and lab[0] != lab[99]
    el = [r["inertia"] for r in U.elbow(pts, range(2, 5), n_init=2).orderBy("k").collect()]
    assert el[0] >= el[1] >= el[2]
    pc = U.pca_2d(pts, keep=["id"])
    m = pc.agg(F.avg("PC1"), F.avg("PC2")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1]) < 1e-9
