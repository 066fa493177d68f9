"""Linear support-vector regression on a (random-feature) vector column.

Objective: 0.5 ||w||^2 + C * sum_i L(y_i - w.x_i - b), with L the
epsilon-insensitive loss smoothed over a width ``delta`` above epsilon (so
the gradient exists everywhere).  Minimised by L-BFGS on the driver (a
vector of size d + 1); every loss/gradient evaluation is one distributed
pass: per task NumPy adds up a partial loss and gradient, a few rows at a time, and Spark
sums them (the partial results are grouped by vector position, so nothing
larger than d + 1 numbers is collected).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTH = 1e-3
#: Rows that a pass looks at together.
PASS_ROWS = 512


def _loss_grad(vec: DataFrame, w: np.ndarray, C: float, eps: float, delta: float, rff: dict | None = None) -> tuple[float, np.ndarray]:
    d = len(w) - 1
    wv, b0 = w[:d], w[d]
    weights, phase = (np.asarray(rff["w"]), np.asarray(rff["b"])) if rff else (None, None)

    def part(batches):
        total = np.zeros(d + 2)
        for b in batches:
            ys = b.column("label").to_numpy(zero_copy_only=False)
            xs = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(ys), -1)
            for at in range(0, len(ys), PASS_ROWS):  # mapped rows are far wider than those they come from
                x, y = xs[at : at + PASS_ROWS], ys[at : at + PASS_ROWS]
                if weights is not None:
                    x = x @ weights
                    x += phase
                    np.cos(x, out=x)
                    x *= math.sqrt(2.0 / d)
                r = y - x @ wv - b0
                u = np.abs(r) - eps
                loss = np.where(u <= 0, 0.0, np.where(u <= delta, u * u / (2 * delta), u - delta / 2))
                dl = np.where(u <= 0, 0.0, np.where(u <= delta, u / delta, 1.0)) * np.sign(r)
                total += np.concatenate([-(dl @ x), [-dl.sum()], [loss.sum()]])
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(d + 2)), "v": pa.array(total)})

    sums = (
        vec.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        .mapInArrow(part, "i long, v double")
        .groupBy("i")
        .agg(F.sum("v").alias("v"))
        .collect()
    )
    tot = np.zeros(d + 2)
    for r in sums:
        tot[r["i"]] = r["v"]
    grad = C * tot[: d + 1]
    grad[:d] += wv
    loss = C * tot[d + 1] + 0.5 * float(wv @ wv)
    return loss, grad


def fit_linear_svr(vec: DataFrame, C: float = 1.0, epsilon: float = 0.1, max_iter: int = 60, tol: float = 1e-6,
                   history: int = 8, rff: dict | None = None) -> dict:
    """Weights {'w': [...], 'b': float} of the smoothed linear SVR, with the steps
    taken and whether loss or gradient settled within ``max_iter`` of them.  With
    ``rff`` every pass maps the features of a batch to their random Fourier
    features, which are never stored."""
    first = vec.select(vector_to_array("features").alias("x")).first()
    d = 0 if not first else len(rff["b"]) if rff else len(first["x"])
    w = np.zeros(d + 1)
    f, g = _loss_grad(vec, w, C, epsilon, SMOOTH, rff)
    s_hist: list[np.ndarray] = []
    y_hist: list[np.ndarray] = []
    steps, converged = 0, False
    while steps < max_iter and not converged:
        steps += 1
        # two-loop recursion for the L-BFGS direction
        qv = g.copy()
        alphas = []
        for s, y in reversed(list(zip(s_hist, y_hist))):
            a = (s @ qv) / (y @ s)
            alphas.append(a)
            qv -= a * y
        if s_hist:
            qv *= (s_hist[-1] @ y_hist[-1]) / (y_hist[-1] @ y_hist[-1])
        for (s, y), a in zip(zip(s_hist, y_hist), reversed(alphas)):
            bcoef = (y @ qv) / (y @ s)
            qv += s * (a - bcoef)
        direction = -qv
        step = 1.0 if s_hist else 1.0 / max(1.0, float(np.linalg.norm(g)))
        while True:
            w_new = w + step * direction
            f_new, g_new = _loss_grad(vec, w_new, C, epsilon, SMOOTH, rff)
            if f_new <= f + 1e-4 * step * float(g @ direction) or step < 1e-10:
                break
            step *= 0.5
        s_vec, y_vec = w_new - w, g_new - g
        w, f_old, f, g = w_new, f, f_new, g_new
        if y_vec @ s_vec > 1e-12:
            s_hist.append(s_vec)
            y_hist.append(y_vec)
            if len(s_hist) > history:
                s_hist.pop(0)
                y_hist.pop(0)
        converged = bool(abs(f_old - f) <= tol * max(1.0, abs(f)) or np.linalg.norm(g) <= tol)
    return {"w": w[:d].tolist(), "b": float(w[d]), "steps": steps, "max_steps": max_iter, "converged": converged}


def predict_linear(vec: DataFrame, weights: dict) -> DataFrame:
    """prediction = w.x + b, JVM-side (dot product of two arrays)."""
    w = F.array(*[F.lit(float(v)) for v in weights["w"]])
    dot = F.aggregate(F.zip_with(vector_to_array("features"), w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
    return vec.withColumn("prediction", dot + F.lit(weights["b"]))


__all__ = ["fit_linear_svr", "predict_linear"]
