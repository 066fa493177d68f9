"""A model exported as one Spark ML pipeline predicts raw rows as the model did."""

import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tablab.operators import stages as G
from tablab.operators import supervised as M


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(a), "xyz"[i % 3], "in" if a * a + 0.2 * e > 0.8 else "out", float(np.sin(a) + (i % 3) + 0.1 * e))
            for i, (a, e) in enumerate(zip(rng.normal(size=160), rng.normal(size=160)))]
    return spark.createDataFrame(rows, "id long, a double, c string, kind string, num double").cache()


MODELS = [("svm", "kind", {"kernel": "rbf", "max_iter": 10}), ("svm", "kind", {"kernel": "rbf", "landmarks": 20, "tol": 0.1}),
          ("svr", "num", {"max_iter": 3}), ("knn", "kind", {}), ("logistic", "kind", {"max_iter": 10}),
          ("random_forest", "num", {"n_estimators": 3, "max_depth": 4}), ("ridge", "num", {})]


@pytest.mark.parametrize("name,target,params", MODELS, ids=lambda v: str(v)[:40])
def test_loaded_pipeline_predicts_raw_rows(spark, table, tmp_path, name, target, params):
    got = M.train_model(table, ["a", "c"], target, name, "regression" if target == "num" else "classification", key=["id"], **params)
    G.export_pipeline(got, f"{tmp_path}/m")
    G.export_pipeline(got, f"{tmp_path}/m")  # replaces itself
    raw = table.join(got.test.select("id"), "id").select("id", "a", "c", F.lit("kept").alias("extra"))
    out = PipelineModel.load(f"{tmp_path}/m/pipeline").transform(raw)
    column = "prediction" if target == "num" else "predicted"
    want = {r["id"]: r[column] for r in got.predictions.select("id", column).collect()}
    found = {r["id"]: r[column] for r in out.select("id", column).collect()}
    assert len(want) > 10 and set(found) == set(want)
    assert all(found[i] == pytest.approx(want[i]) if target == "num" else found[i] == want[i] for i in want)
    assert "extra" in out.columns or name == "knn"


def test_a_fresh_process_needs_only_the_folder(spark, table, tmp_path):
    got = M.train_model(table, ["a", "c"], "kind", "logistic", "classification", key=["id"], max_iter=5)
    G.export_pipeline(got, f"{tmp_path}/m")
    table.write.parquet(f"{tmp_path}/rows")
    code = f"""
from tablab.session import local_session
from pyspark.ml import PipelineModel
s = local_session(2)
out = PipelineModel.load({f'{tmp_path}/m/pipeline'!r}).transform(s.read.parquet({f'{tmp_path}/rows'!r}))
print(sorted(map(tuple, out.select("id", "predicted").collect())))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200, cwd=M.__file__.rsplit("/tablab/", 1)[0])
    want = sorted(map(tuple, G.load_pipeline(f"{tmp_path}/m").transform(table).select("id", "predicted").collect()))
    assert done.stdout.strip().endswith(str(want)), done.stderr[-2000:]
