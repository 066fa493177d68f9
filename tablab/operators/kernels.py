"""Support-vector machines with a certificate (M9, M10): landmark features and a duality gap.

**Features.**  A kernel k is replaced by its landmark (Nystrom) approximation: with m rows L chosen by the hash of their
keys, z(x) = k(x, L) U s^(-1/2) for k(L, L) = U diag(s) U'.  Inner products of z equal the kernel on the landmarks and
approximate it elsewhere; with every row a landmark the model is the exact kernel machine.  Only m rows (a parameter) and
the m x m basis are constants of the model.  z is computed inside each pass, so no table of mapped rows is kept.

**Objective** (intercept b not penalised), of classes (y = +1, -1, eps = 0, s = y) and of regression (s = sign(y - f)):

    P(w, b) = 1/2 |w|^2 + C sum max(0, u),   u = s (y - f) - eps,   f = w.z + b

**Steps.**  max(0, u) is smoothed over a width that shrinks as the fit settles, and minimised by Newton steps.  One pass over the
rows adds up gradient, curvature and losses of all classes together: NumPy per Arrow batch, then one row per partition
whose sums are added in two levels, so neither a task nor the driver holds more than a few of them.

**Certificate.**  The smoothed loss of any (w, b) gives dual weights a = C clip(u / width, 0, 1).  Scaled so that
sum(a s) = 0 they are feasible, and D = sum a (s y - eps) - 1/2 |sum a s z|^2 is a lower bound of the optimum whatever
the state of the fit.  The same pass yields it.  ``converged`` means P - D <= tol * P, a statement about the distance to
the optimum, not about step lengths.

Rows whose features or label are null or not finite take no part in a fit; a table without rows gives zero weights.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablab.functions.hashing import key_hash
from tablab.functions.names import private
from tablab.functions.small import collect_bounded

KERNELS = ("linear", "rbf", "poly")
MAX_LANDMARKS = 2048
ADDED_AT_ONCE = 64  # partial sums that one task adds up
STEP_LENGTHS = [2.0**-i for i in range(1, 25)]


# --------------------------------------------------------------- landmark features
def choose_landmarks(vec: DataFrame, key: list[str], count: int, seed: int = 42) -> np.ndarray:
    """The ``count`` rows of smallest key hash (ties: smaller vector): a uniform sample of rows that no partitioning changes."""
    if not 1 <= count <= MAX_LANDMARKS:
        raise ValueError(f"landmarks must be in 1..{MAX_LANDMARKS}")
    h, x = private(vec.columns, "h", "x")
    found = vec.select(key_hash(key, seed).alias(h), vector_to_array("features").alias(x)).orderBy(h, x).limit(count)
    rows = collect_bounded(found, count, "landmarks")
    return np.array([r[x] for r in rows], dtype=float)


def _kernel(a: np.ndarray, b: np.ndarray, kernel: str, gamma: float, degree: int, coef0: float) -> np.ndarray:
    inner = a @ b.T
    if kernel == "poly":
        return (gamma * inner + coef0) ** degree
    return np.exp(-gamma * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * inner, 0.0))


def landmark_map(points: np.ndarray, kernel: str, gamma: float, degree: int = 3, coef0: float = 0.0) -> dict:
    """Constants of z(x).  Directions of no weight (repeated or dependent landmarks) are left out."""
    if kernel not in KERNELS:
        raise ValueError(f"kernels: {KERNELS}")
    params = {"kernel": kernel, "gamma": gamma, "degree": degree, "coef0": coef0}
    if kernel == "linear" or len(points) == 0:
        return params | {"kernel": "linear", "points": None, "basis": None}
    s, u = np.linalg.eigh(_kernel(points, points, kernel, gamma, degree, coef0))
    keep = s > 1e-10 * s.max()
    return params | {"points": points.tolist(), "basis": (u[:, keep] / np.sqrt(s[keep])).tolist()}


def _mapped(x: np.ndarray, m: dict) -> np.ndarray:
    if m["points"] is None:
        return x
    return _kernel(x, np.asarray(m["points"]), m["kernel"], m["gamma"], m["degree"], m["coef0"]) @ np.asarray(m["basis"])


# --------------------------------------------------------------- one pass over the rows
def _add_blobs(key: str):
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(pdf["sums"].iloc[0]) // 8)
        for blob in pdf["sums"]:
            total += np.frombuffer(blob)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "slot": [pdf["slot"].iloc[0] if key == "slot" else 0], "sums": [total.tobytes()]})

    return add


def _added(rows: DataFrame, n_parts: int, tasks: int) -> dict[int, np.ndarray]:
    """Sum of the blobs of each part: of many tasks first about sqrt(tasks) at a time, then the results."""
    slots = math.isqrt(tasks) if tasks > ADDED_AT_ONCE else 1
    schema = "part int, slot int, sums binary"
    rows = rows.withColumn("slot", (F.spark_partition_id() % slots).cast("int"))
    rows = rows.groupBy("part", "slot").applyInPandas(_add_blobs("slot"), schema)
    if slots > 1:
        rows = rows.groupBy("part").applyInPandas(_add_blobs("part"), schema)
    return {r["part"]: np.frombuffer(bytes(r["sums"])) for r in collect_bounded(rows, n_parts, "partial sums")}


def _signs(y: np.ndarray, cls: float | None, f: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(s, y, eps) of the objective: of membership in a class, or of a number."""
    if cls is None:
        return np.where(y >= f, 1.0, -1.0), y, eps
    sign = np.where(y == cls, 1.0, -1.0)
    return sign, sign, 0.0


def _rows_of(x: pd.Series) -> np.ndarray:
    """A column of arrays of one length as a matrix, without a second array per row."""
    rows = x.to_numpy()
    if len(set(map(len, rows))) > 1:
        raise ValueError("rows have different numbers of features")
    return np.concatenate(rows).reshape(len(rows), -1)


def _derivatives(rows: DataFrame, m: dict, states: dict, eps: float, tasks: int) -> dict[int, dict]:
    """Per part: loss, its smoothed form, gradient and curvature (without C), and per sign of s the sums of the dual weights,
    of their gains and of their vectors."""
    dim = len(next(iter(states.values()))["w"])

    def partial(batches):
        totals = {}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = _mapped(_rows_of(pdf["x"]), m)
            z1 = np.column_stack([z, np.ones(len(z))])
            y0 = pdf["y"].to_numpy(dtype=float)
            for part, st in states.items():
                f = z1 @ st["w"]
                s, y, e = _signs(y0, st["cls"], f, eps)
                u, width = s * (y - f) - e, st["width"]
                a = np.clip(u / width, 0.0, 1.0)
                bent = (u > 0) & (u < width)
                zb = z1[bent]
                out = [np.where(u <= 0, 0.0, np.where(u <= width, u * u / (2 * width), u - width / 2)).sum(), np.maximum(u, 0.0).sum()]
                for sign in (1.0, -1.0):
                    mine = np.where(s == sign, a, 0.0)
                    out += [mine.sum(), mine @ (s * y - e), *(mine @ z)]
                sums = np.concatenate([out, (zb.T @ zb / width).ravel()])
                totals[part] = totals[part] + sums if part in totals else sums
        for part, sums in totals.items():
            yield pd.DataFrame({"part": [part], "sums": [sums.tobytes()]})

    found = _added(rows.mapInPandas(partial, "part int, sums binary"), len(states), tasks)
    out = {}
    for part in states:
        v = found.get(part, np.zeros(2 + 2 * (dim + 1) + dim * dim))
        up, down = v[2 : 3 + dim], v[3 + dim : 4 + 2 * dim]
        out[part] = {
            "smooth": v[0], "loss": v[1], "up": up, "down": down,
            "grad": -np.concatenate([up[2:] - down[2:], [up[0] - down[0]]]),
            "curve": v[4 + 2 * dim :].reshape(dim, dim),
        }
    return out


def _smooth_losses(rows: DataFrame, m: dict, states: dict, moves: dict, eps: float, tasks: int) -> dict[int, np.ndarray]:
    """Per part the smoothed loss at each of STEP_LENGTHS along its move."""
    def partial(batches):
        totals = {part: np.zeros(len(STEP_LENGTHS)) for part in moves}
        for pdf in batches:
            if len(pdf) == 0:
                continue
            z = _mapped(_rows_of(pdf["x"]), m)
            z1 = np.column_stack([z, np.ones(len(z))])
            y0 = pdf["y"].to_numpy(dtype=float)
            for part, move in moves.items():
                st = states[part]
                start, along = z1 @ st["w"], z1 @ move
                for i, t in enumerate(STEP_LENGTHS):
                    f = start + t * along
                    s, y, e = _signs(y0, st["cls"], f, eps)
                    u, width = s * (y - f) - e, st["width"]
                    totals[part][i] += np.where(u <= 0, 0.0, np.where(u <= width, u * u / (2 * width), u - width / 2)).sum()
        for part, sums in totals.items():
            yield pd.DataFrame({"part": [part], "sums": [sums.tobytes()]})

    return _added(rows.mapInPandas(partial, "part int, sums binary"), len(moves), tasks)


def _dual(d: dict, C: float) -> float:
    """Lower bound of the optimum: the dual weights of both signs scaled to equal sums, then as a whole to the best factor <= 1."""
    if min(d["up"][0], d["down"][0]) <= 0:
        return 0.0
    even = min(d["up"][0], d["down"][0])
    up, down = C * d["up"] * (even / d["up"][0]), C * d["down"] * (even / d["down"][0])
    gain, vector = up[1] + down[1], up[2:] - down[2:]
    size = float(vector @ vector)
    factor = 1.0 if size <= 0 else min(1.0, max(0.0, gain / size))
    return float(factor * gain - 0.5 * factor * factor * size)


# --------------------------------------------------------------- fit
def _descend(derivatives, smooth_losses, states: dict, C: float, tol: float, max_passes: int) -> dict[int, dict]:
    """Newton steps of all parts together until each one's certificate holds; every call of the two functions is a pass."""
    best = {i: {"primal": math.inf, "dual": 0.0, "passes": 0, "converged": False, "w": s["w"]} for i, s in states.items()}
    previous: dict[int, tuple] = {}  # where a part came from: (weights, smoothed objective, move)
    active, passes = set(states), 0
    while active and passes < max_passes:
        passes += 1
        found = derivatives({i: states[i] for i in active})
        short = {}
        for i in sorted(active):
            st, d, b = states[i], found[i], best[i]
            w = st["w"][:-1]
            primal, smooth = 0.5 * w @ w + C * d["loss"], 0.5 * w @ w + C * d["smooth"]
            dual = _dual(d, C)
            b["passes"], b["dual"] = passes, max(b["dual"], dual)
            if primal < b["primal"]:
                b.update(primal=float(primal), w=st["w"].copy())
            if b["primal"] - b["dual"] <= tol * b["primal"] + 1e-12:
                b["converged"] = True
                active.discard(i)
                continue
            if i in previous and smooth > previous[i][1] + 1e-12 * abs(previous[i][1]):
                short[i] = previous[i]  # the whole step went up: look for a shorter one
                continue
            grad = C * d["grad"] + np.r_[w, 0.0]
            curve = C * d["curve"]
            curve[np.arange(len(w)), np.arange(len(w))] += 1.0
            # few rows within the width say nothing about the intercept: keep its step to the order of the first width
            curve[-1, -1] = max(curve[-1, -1], C * (d["up"][0] + d["down"][0]) / st["first_width"], 1e-12)
            move = -np.linalg.lstsq(curve, grad, rcond=None)[0]
            if -grad @ move <= 1e-4 * tol * max(smooth, 1e-12):
                st["width"] *= 0.3  # settled at this width
                previous.pop(i, None)
                continue
            previous[i] = (st["w"], smooth, move)
            st["w"] = st["w"] + move
        if short and passes < max_passes:
            passes += 1
            origin = {i: {**states[i], "w": w} for i, (w, _, _) in short.items()}
            losses = smooth_losses(origin, {i: move for i, (_, _, move) in short.items()})
            for i, (w, before, move) in short.items():
                at = [w + t * move for t in STEP_LENGTHS]
                value = [0.5 * p[:-1] @ p[:-1] + C * loss for p, loss in zip(at, losses[i])]
                k = int(np.argmin(value))
                if value[k] < before:
                    states[i]["w"] = at[k]
                else:
                    states[i].update(w=w, width=states[i]["width"] * 0.3)
                previous.pop(i)
    return best


def fit_certified(vec: DataFrame, m: dict, classes: list[float] | None, C: float = 1.0, epsilon: float = 0.1, tol: float = 0.01,
                  max_passes: int = 100) -> dict:
    """Weights of one machine per class (of two classes: one, for the second; ``None``: regression of ``label``) and the
    certificate of each.  ``vec`` has ``features`` and ``label`` and is read once per pass; cache it if it is costly."""
    if C <= 0 or epsilon < 0 or tol <= 0:
        raise ValueError("C and tol must be positive, epsilon not negative")
    x = vector_to_array("features")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))
    rows = vec.select(x.alias("x"), F.col("label").cast("double").alias("y")).where(finite(F.col("y")) & F.forall("x", finite))
    facts = rows.select("*", F.spark_partition_id().alias("task")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"), F.max(F.size("x")).alias("d"),
        F.countDistinct("task").alias("tasks")).first()
    raw = facts["d"] or 0
    dim = raw if m["basis"] is None else len(m["basis"][0])
    if classes is None:
        parts, start, width = [None], float(facts["mean"] or 0.0), 4.0 * float(facts["sd"] or 0.0) or 1.0
    else:
        parts, start, width = ([classes[1]] if len(classes) == 2 else list(classes)), 0.0, 2.0
    states = {i: {"w": np.r_[np.zeros(dim), start], "width": width, "first_width": width, "cls": c} for i, c in enumerate(parts)}
    best = {i: {"primal": 0.0, "dual": 0.0, "passes": 0, "converged": True, "w": s["w"]} for i, s in states.items()}
    if facts["n"]:  # a fit without rows has nothing to settle
        best = _descend(lambda now: _derivatives(rows, m, now, epsilon, facts["tasks"]),
                        lambda at, moves: _smooth_losses(rows, m, at, moves, epsilon, facts["tasks"]), states, C, tol, max_passes)
    return {
        "map": m,
        "classes": classes,
        "w": [best[i]["w"].tolist() for i in sorted(best)],
        "max_passes": max_passes,
        "certificates": [{k: best[i][k] for k in ("primal", "dual", "passes", "converged")} for i in sorted(best)],
    }


def predict_certified(vec: DataFrame, fit: dict) -> DataFrame:
    """``prediction``, and of classes ``rawPrediction`` (a margin per class), mapped per Arrow batch."""
    weights, m = np.array(fit["w"]).T, fit["map"]

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def margins(xs: pd.Series) -> pd.Series:
        if len(xs) == 0:
            return pd.Series([], dtype=object)
        z = _mapped(np.vstack(xs.to_numpy()), m)
        return pd.Series(list(np.column_stack([z, np.ones(len(z))]) @ weights))

    (f,) = private(vec.columns, "margins")
    out = vec.withColumn(f, margins(vector_to_array("features")))
    if fit["classes"] is None:
        return out.withColumn("prediction", F.element_at(f, 1)).drop(f)
    if len(fit["classes"]) == 2:
        out = out.withColumn(f, F.array(-F.element_at(f, 1), F.element_at(f, 1)))
    order = F.array(*[F.lit(float(c)) for c in fit["classes"]])
    first = F.array_position(f, F.array_max(f)).cast("int")
    return out.withColumn("rawPrediction", array_to_vector(f)).withColumn("prediction", F.element_at(order, first)).drop(f)


__all__ = ["choose_landmarks", "landmark_map", "fit_certified", "predict_certified", "KERNELS", "MAX_LANDMARKS"]
