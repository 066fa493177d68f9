"""Certified kernel machines against a plain solver of the same problem."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablab.operators import kernels as K
from tablab.operators import supervised as M


def exact_optimum(gram, y, C, eps=None, sweeps=1000):
    """Optimum of the dual by pairwise coordinate steps (maximal violating pair), from the kernel matrix alone.  Of numbers
    (``eps`` given) each row has two dual weights, one per side of the tube."""
    n = len(y)
    if eps is None:
        s, gain, q = y.astype(float), np.ones(n), gram
    else:
        s, gain, q = np.r_[np.ones(n), -np.ones(n)], np.r_[y - eps, -y - eps], np.tile(gram, (2, 2))
    a, grad = np.zeros(len(s)), -gain.copy()
    h = q * np.outer(s, s)
    for _ in range(sweeps * 50):
        score = -s * grad
        up = np.where(((s > 0) & (a < C)) | ((s < 0) & (a > 0)), score, -np.inf)
        low = np.where(((s > 0) & (a > 0)) | ((s < 0) & (a < C)), score, np.inf)
        i, j = int(up.argmax()), int(low.argmin())
        if up[i] - low[j] < 1e-7:
            break
        t = (up[i] - low[j]) / max(q[i, i] + q[j, j] - 2 * q[i, j], 1e-12)
        t = min(t, (C - a[i]) if s[i] > 0 else a[i], a[j] if s[j] > 0 else (C - a[j]))
        a[i] += s[i] * t
        a[j] -= s[j] * t
        grad += h[:, i] * (s[i] * t) - h[:, j] * (s[j] * t)
    return float(gain @ a - 0.5 * a @ h @ a)


def points(n=150, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    return x, np.where((x**2).sum(1) + 0.4 * rng.normal(size=n) > 1.4, 1.0, 0.0), np.sin(2 * x[:, 0]) + x[:, 1] + 0.2 * rng.normal(size=n)


def frame(spark, x, y, parts=5):
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, label double").repartition(parts).withColumn("features", array_to_vector("x"))


class Batches:
    """The rows of a pass as two batches of one task, without a session."""

    def __init__(self, x, y):
        self.parts = [pd.DataFrame({"x": list(x[i::2]), "y": y[i::2]}) for i in (0, 1)]

    def mapInPandas(self, fn, schema):
        return list(fn(iter(self.parts)))


def descend(monkeypatch, x, y, m, cls, C, eps=0.1, tol=0.01, passes=100):
    monkeypatch.setattr(K, "_added", lambda rows, n, tasks: {int(r["part"].iloc[0]): np.frombuffer(r["sums"].iloc[0]) for r in rows})
    dim = x.shape[1] if m["basis"] is None else len(m["basis"][0])
    width, start = (2.0, 0.0) if cls is not None else (4 * y.std(), y.mean())
    states = {0: {"w": np.r_[np.zeros(dim), start], "width": width, "first_width": width, "cls": cls}}
    rows = Batches(x, y)
    return K._descend(lambda now: K._derivatives(rows, m, now, eps, 1), lambda at, moves: K._smooth_losses(rows, m, at, moves, eps, 1), states, C, tol, passes)[0]


@pytest.mark.parametrize("kernel", ["linear", "rbf", "poly"])
@pytest.mark.parametrize("C", [0.5, 1.0, 5.0])
@pytest.mark.parametrize("numbers", [False, True])
def test_objective_within_the_gap_of_the_exact_machine(monkeypatch, kernel, C, numbers):
    x, y, num = points(120)
    m = K.landmark_map(x, kernel, 0.5, 3, 1.0)  # every row a landmark: the exact machine
    cert = descend(monkeypatch, x, num + 100 if numbers else y, m, None if numbers else 1.0, C)
    gram = x @ x.T if kernel == "linear" else K._kernel(x, x, kernel, 0.5, 3, 1.0)
    best = exact_optimum(gram, num + 100 if numbers else np.where(y == 1, 1, -1), C, 0.1 if numbers else None)
    assert cert["converged"] and cert["dual"] <= best * (1 + 1e-3) and best * (1 - 1e-3) <= cert["primal"] <= best * 1.0101


@pytest.mark.parametrize("seed", range(4))
def test_any_table_settles(monkeypatch, seed):
    x, y, num = points(1500, seed)
    for kernel in ("rbf", "poly"):
        m = K.landmark_map(x[:100], kernel, 0.5, 3, 1.0)
        assert descend(monkeypatch, x, y, m, 1.0, 20.0)["converged"] and descend(monkeypatch, x, num, m, None, 1.0)["converged"]


@pytest.mark.parametrize("tasks", [1, 3, 100])
def test_partitions_and_levels_of_sums_do_not_matter(spark, tasks):
    x, y, _ = points(120)
    m = K.landmark_map(x[:40], "rbf", 0.5)
    rows = frame(spark, x, y, tasks).select("x", F.col("label").alias("y"))
    w = np.linspace(-1, 1, len(m["basis"][0]) + 1)
    states = {0: {"w": w, "width": 0.7, "cls": 1.0}, 1: {"w": -w, "width": 0.2, "cls": 0.0}}
    got = K._derivatives(rows, m, states, 0.1, tasks)
    z = np.column_stack([K._mapped(x, m), np.ones(len(x))])
    for i, s in ((0, 2 * y - 1), (1, 1 - 2 * y)):
        u, width = 1 - s * (z @ states[i]["w"]), states[i]["width"]
        assert got[i]["loss"] == pytest.approx(np.maximum(u, 0).sum())
        assert got[i]["grad"] == pytest.approx(-(np.clip(u / width, 0, 1) * s) @ z)
        bent = z[(u > 0) & (u < width)]
        assert got[i]["curve"] == pytest.approx(bent.T @ bent / width)


def test_landmark_features_equal_the_kernel_on_landmarks(spark):
    x, y, _ = points(60)
    vec = frame(spark, np.vstack([x, x[:10]]), np.r_[y, y[:10]])  # repeated rows: a singular matrix
    chosen = K.choose_landmarks(vec, ["id"], 40)
    assert np.array_equal(chosen, K.choose_landmarks(vec.repartition(13), ["id"], 40))
    z = K._mapped(chosen, K.landmark_map(chosen, "rbf", 0.5))
    assert np.allclose(z @ z.T, K._kernel(chosen, chosen, "rbf", 0.5, 3, 0.0), atol=1e-6)


def test_unfinished_fits_say_so_and_odd_rows_stay_out(spark):
    x, y, _ = points(90)
    vec = frame(spark, x, y)
    m = K.landmark_map(K.choose_landmarks(vec, ["id"], 30), "rbf", 0.5)
    (short,) = K.fit_certified(vec, m, [0.0, 1.0], max_passes=2)["certificates"]
    assert not short["converged"] and short["primal"] - short["dual"] > 0.01 * short["primal"]
    odd = vec.unionByName(spark.createDataFrame([(900, [float("nan"), 1.0], 1.0), (901, [0.0, float("inf")], 0.0), (902, [0.0, 0.0], None)],
                                                "id long, x array<double>, label double").withColumn("features", array_to_vector("x")))
    a, b = (K.fit_certified(v, m, [0.0, 1.0], max_passes=3)["certificates"][0] for v in (vec, odd))
    assert a["primal"] == pytest.approx(b["primal"], rel=1e-6)
    nothing = K.fit_certified(vec.where("id < 0"), m, [0.0, 1.0])
    assert nothing["certificates"][0]["converged"] and not any(nothing["w"][0])


def test_models_with_landmarks_save_load_and_predict(spark, tmp_path):
    x, y, num = points(240)
    rows = [(i, float(a), float(b), "in" if c else "out", float(d), i % 3) for i, ((a, b), c, d) in enumerate(zip(x, y, num))]
    df = spark.createDataFrame(rows, "id long, a double, b double, cls string, num double, three int").withColumn(
        "three", (F.col("a") > 0.4).cast("int") + (F.col("a") > -0.4).cast("int"))
    for target, task, name in (("cls", "classification", "svm"), ("three", "classification", "svm"), ("num", "regression", "svr")):
        got = M.train_model(df, ["a", "b"], target, name, task, key=["id"], landmarks=30, C=1.0)
        assert all(r.converged and 0 <= r.gap <= 0.01 * r.primal + 1e-9 for r in M.certificates(got).collect())
        value = got.metrics().first().asDict()
        assert max(value.get("accuracy", 0), value.get("r2", 0)) > 0.85, value
        M.save_model(got, f"{tmp_path}/{target}")
        again, _ = M.load_model(spark, f"{tmp_path}/{target}")
        want = {r["id"]: r["prediction"] for r in got.model.transform(got.test).select("id", "prediction").collect()}
        assert want and want == {r["id"]: r["prediction"] for r in again.transform(got.test).select("id", "prediction").collect()}
