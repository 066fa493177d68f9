"""Supervised learning.

Flow: prepare (select, drop rows with nulls, label-encode text features and
text targets) -> deterministic hash split -> scaling fitted on the training
rows only -> Spark ML estimator -> predictions on the test rows -> metrics as
aggregates.  Every fit is a distributed Spark ML job; only model weights and
fitted constants reach the driver.

Parameter mapping to the usual single-machine defaults:

* logistic regression, L2 with inverse strength C: ``regParam = 1 / (C n)``,
  no internal standardisation (same optimum; Spark scales the loss by 1/n);
* ridge with strength alpha: ``regParam = alpha * sd_pop(y) / n`` on the
  normal-equation solver (Spark penalises the label-standardised problem);
* linear SVM with C: ``regParam = 1 / (C n)``; one-vs-rest beyond 2 classes;
* rbf kernels use random Fourier features (gamma = 1 / (d var(X))) followed
  by the linear model; poly uses a degree-3 polynomial expansion;
* with ``landmarks=m`` both SVMs use landmark features and are fitted to a
  duality gap ``tol`` (:mod:`tablab.operators.kernels`);
* SVM class probabilities: a logistic fit on the margins of the training rows;
* forests: Spark trees end at depth 30, which ``max_depth=None`` means;
  ``min_samples_split`` cuts the fitted trees at nodes of fewer rows
  (:mod:`tablab.operators.forests`), ``min_samples_leaf`` bounds leaves.

Classification targets of any type are indexed by their distinct values in
ascending order; predictions, confusion matrices and ROC curves carry the
values again.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablab.functions.kinds import is_numeric_type, require_columns
from tablab.functions.long import q
from tablab.functions.names import private
from tablab.functions.small import one_row
from tablab.operators import grid_forest as GF
from tablab.operators import metrics as M
from tablab.operators import profile as P
from tablab.operators import split as S
from tablab.operators import transform as X
from tablab.operators.forests import cut_small_nodes, join_forests

MAX_SPARK_DEPTH = 30
RFF_COMPONENTS = 256
#: Rows that are mapped to random features at a time.
RFF_ROWS = 512

CLASSIFIERS = ("random_forest", "logistic", "svm", "knn")
REGRESSORS = ("random_forest", "linear", "ridge", "svr")


# --------------------------------------------------------------- M1
@dataclass
class Prepared:
    """Model-ready rows: ``df`` holds the key columns, the (encoded) feature
    columns and ``label``; encoders are the fitted label-code tables."""

    df: DataFrame
    features: list[str]
    target: str
    task: str
    key: list[str]
    feature_codes: dict = field(default_factory=dict)
    class_codes: dict | None = None

    @property
    def classes(self) -> list | None:
        return None if self.class_codes is None else self.class_codes.get("classes")


def _array_feature(df: DataFrame, features: Sequence[str]) -> bool:
    return len(features) == 1 and isinstance(df.schema[features[0]].dataType, T.ArrayType)


def prepare_xy(
    df: DataFrame,
    features: Sequence[str] | None,
    target: str,
    key: Sequence[str] | None = None,
    task: str | None = None,
) -> Prepared:
    """Select features + target (default features: every column but the
    target), drop rows with a null in any of them, label-encode text features
    and -- for classification -- the target (``label`` is its class's index).
    A single array column is accepted as the feature vector.  Without a ``key`` a
    row's columns identify it, and among equal rows a number."""
    require_columns(df, [target])
    feats = [c for c in df.columns if c != target] if features is None else list(features)
    key = list(key) if key else []
    require_columns(df, feats + key)
    taken = [c for c in dict.fromkeys(key + feats) if c.lower() in RESERVED and c != target]
    if taken:
        raise ValueError(f"rename column(s) {taken}: a model's own columns have these names")
    task = task or P.task_of(df, target)
    if task not in ("classification", "regression"):
        raise ValueError("task must be classification or regression")
    cols = list(dict.fromkeys(key + feats + [target]))
    data = df.select(*[q(c) for c in cols]).na.drop(how="any", subset=feats + [target])
    codes = {}
    if not _array_feature(data, feats):
        for c in feats:
            if not is_numeric_type(data.schema[c].dataType):
                codes[c] = X.fit_label_encode(data, c)
                data = X.apply_label_encode(data, c, codes[c])
    class_codes = None
    if task == "classification":
        class_codes = X.fit_classes(data, target)
        data = X.apply_label_encode(data, target, class_codes)
    elif task == "regression" and not is_numeric_type(data.schema[target].dataType):
        raise ValueError(f"regression target {target!r} is not numeric")
    data = data.withColumn("label", q(target).cast("double"))
    if target != "label":
        data = data.drop(target)
    if not key:
        data, key = _numbered_copies(data, feats + ["label"])
    return Prepared(data, feats, target, task, key, codes, class_codes)


#: Columns that a fit or a prediction adds; features and keys must have other names.
RESERVED = ("label", "features", "prediction", "rawprediction", "probability", "poly", "actual", "predicted")


def _numbered_copies(data: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows without a key: their own columns, and among equal rows the number of the copy, identify them.  Equal rows are
    counted (partially aggregated) and dealt out again, so a split or fold takes its share of them; the first copy has
    no number, which leaves the hash of a row that stands alone as it is."""
    copies, copy = private(cols, "copies", "copy")
    counted = data.groupBy(*[q(c) for c in cols]).agg(F.count(F.lit(1)).alias(copies))
    numbers = F.transform(F.sequence(F.lit(1).cast("long"), F.col(copies)), lambda i: F.when(i > 1, i))
    return counted.select(*[q(c) for c in cols], F.explode(numbers).alias(copy)), [*cols, copy]


# --------------------------------------------------------------- M3
class _FeatureVector(Transformer):
    """Assemble (and optionally standard-scale with fitted constants) the
    feature columns into one vector column; a pure projection."""

    def __init__(self, features: list[str], scale_params: dict | None):
        super().__init__()
        self.feature_cols = list(features)
        self.scale_params = scale_params

    def _transform(self, df: DataFrame) -> DataFrame:
        if len(self.feature_cols) == 1 and isinstance(df.schema[self.feature_cols[0]].dataType, T.ArrayType):
            c = self.feature_cols[0]
            arr = F.transform(q(c), lambda v: v.cast("double"))
            if self.scale_params:
                mean = F.array(*[F.lit(m) for m in self.scale_params["mean"]])
                sd = F.array(*[F.lit(s) for s in self.scale_params["sd"]])
                arr = F.zip_with(F.zip_with(arr, mean, lambda a, m: a - m), sd, lambda a, s: a / s)
            return df.withColumn("features", array_to_vector(arr))
        cols = self.feature_cols
        work = X.apply_scale(df, self.scale_params) if self.scale_params else df
        tmp = [f"_f{i}" for i in range(len(cols))]
        work = work.select("*", *[q(c).cast("double").alias(t) for c, t in zip(cols, tmp)])
        out = VectorAssembler(inputCols=tmp, outputCol="features", handleInvalid="keep").transform(work)
        return out.drop(*tmp)


def fit_standard(prep: Prepared, train: DataFrame) -> dict:
    """Mean / population sd of each feature on the training rows."""
    if _array_feature(train, prep.features):
        c = prep.features[0]
        width = one_row(train.agg(F.max(F.size(q(c))).alias("w")))["w"] or 0
        elems = [F.element_at(q(c), i + 1).cast("double") for i in range(width)]
        row = one_row(train.agg(*[F.avg(e).alias(f"m{i}") for i, e in enumerate(elems)],
                                *[F.stddev_pop(e).alias(f"s{i}") for i, e in enumerate(elems)]))
        return {
            "mean": [row[f"m{i}"] or 0.0 for i in range(width)],
            "sd": [row[f"s{i}"] if row[f"s{i}"] else 1.0 for i in range(width)],
        }
    return X.fit_scale(train, prep.features, "standard")


# ----------------------------------------------------- random features
def rff_params(dim: int, gamma: float, components: int = RFF_COMPONENTS, seed: int = 42) -> dict:
    """W ~ N(0, 2 gamma), b ~ U(0, 2 pi) for z(x) = sqrt(2/D) cos(W x + b):
    an explicit map whose inner products approximate the rbf kernel
    (Rahimi & Recht, 2007).  Size dim x components, kept as fitted constants."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(dim, components))
    b = rng.uniform(0.0, 2.0 * math.pi, size=components)
    return {"w": w.tolist(), "b": b.tolist()}


def _fourier(batches: Iterator[pd.Series], w: np.ndarray, b: np.ndarray) -> Iterator[pd.Series]:
    """The mapped rows in order, at most ``RFF_ROWS`` to a series."""
    for xs in batches:
        for at in range(0, len(xs), RFF_ROWS):
            mat = np.vstack(xs.iloc[at : at + RFF_ROWS].to_numpy())
            yield pd.Series(list(math.sqrt(2.0 / len(b)) * np.cos(mat @ w + b)), dtype=object)


def apply_rff(df: DataFrame, params: dict, col: str = "features") -> DataFrame:
    """Replace the vector column by its random Fourier features, vectorised
    with NumPy over ``RFF_ROWS`` rows of an Arrow batch at a time: the mapped
    rows are far wider than those they come from."""
    w = np.asarray(params["w"])
    b = np.asarray(params["b"])

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def rff(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _fourier(batches, w, b)

    return df.withColumn(col, array_to_vector(rff(vector_to_array(col))))


def rbf_gamma(train_vec: DataFrame, dim: int) -> float:
    """gamma = 1 / (d * var(X)) over all feature values (the 'scale' rule)."""
    v = one_row(train_vec.select(F.explode(vector_to_array("features")).alias("v")).agg(F.var_pop("v").alias("v")))["v"]
    return 1.0 / (dim * v) if v else 1.0


# --------------------------------------------------------------- models
@dataclass
class ModelSpec:
    name: str
    task: str
    params: dict = field(default_factory=dict)


def _depth(params: dict) -> int:
    d = params.get("max_depth")
    if d is None:
        return MAX_SPARK_DEPTH
    if not 1 <= d <= MAX_SPARK_DEPTH:
        raise ValueError(f"max_depth must be in 1..{MAX_SPARK_DEPTH}")
    return int(d)


def build_estimator(spec: ModelSpec, n_train: int, n_classes: int = 2, label_sd: float | None = None,
                    seed: int = 42) -> list:
    """Spark ML stages (after the feature map) for one model specification."""
    p = spec.params
    if spec.task == "classification":
        if spec.name == "random_forest":
            return [RandomForestClassifier(
                numTrees=int(p.get("n_estimators", 100)), maxDepth=_depth(p),
                minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
                featureSubsetStrategy="sqrt", seed=seed, maxBins=32,
                maxMemoryInMB=1024, cacheNodeIds=True)]
        if spec.name == "logistic":
            c = float(p.get("C", 1.0))
            return [LogisticRegression(regParam=1.0 / (c * n_train), elasticNetParam=0.0, standardization=False,
                                       maxIter=int(p.get("max_iter", 1000)), tol=1e-8)]
        if spec.name == "svm":
            c = float(p.get("C", 1.0))
            svc = LinearSVC(regParam=1.0 / (c * n_train), standardization=False, maxIter=int(p.get("max_iter", 100)))
            # one binary SVM per class, trained concurrently (each is a distributed job)
            est = svc if n_classes <= 2 else OneVsRest(classifier=svc, parallelism=min(int(n_classes), 8))
            if p.get("kernel", "rbf") == "poly":
                return [PolynomialExpansion(degree=3, inputCol="features", outputCol="poly"),
                        est.copy().setFeaturesCol("poly") if hasattr(est, "setFeaturesCol") else est]
            return [est]
        raise ValueError(f"unknown classifier {spec.name!r}")
    if spec.name == "random_forest":
        return [RandomForestRegressor(
            numTrees=int(p.get("n_estimators", 100)), maxDepth=_depth(p),
            minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
            featureSubsetStrategy="all", seed=seed, maxBins=32,
            maxMemoryInMB=1024, cacheNodeIds=True)]
    if spec.name == "linear":
        return [LinearRegression(solver="normal", regParam=0.0)]
    if spec.name == "ridge":
        alpha = float(p.get("alpha", 1.0))
        return [LinearRegression(solver="normal", regParam=alpha * (label_sd or 1.0) / n_train,
                                 elasticNetParam=0.0, standardization=False)]
    raise ValueError(f"unknown regressor {spec.name!r}")


@dataclass
class FittedModel:
    """Fitted constants (feature scaling, random-feature map, SVR weights)
    applied as projections, followed by an optional Spark ML model."""

    features: list[str]
    scale_params: dict | None
    rff: dict | None
    ml: PipelineModel | None
    svr: dict | None = None
    platt: list | None = None  # per class (slope, intercept) on the SVM's margin
    knn: dict | None = None  # train (vectors), key, k, classes
    kernel: dict | None = None  # landmark features, weights and certificates
    fits: list = field(default_factory=list)  # (part, steps, most steps, converged) of every iterative fit

    def vectors(self, df: DataFrame) -> DataFrame:
        out = _FeatureVector(self.features, self.scale_params).transform(df)
        return apply_rff(out, self.rff) if self.rff else out

    def transform(self, df: DataFrame) -> DataFrame:
        v = self.vectors(df)
        if self.svr is not None:
            from tablab.operators.svr import predict_linear

            return predict_linear(v, self.svr)
        if self.knn is not None:
            from tablab.operators.neighbors import knn_predict

            return knn_predict(self.knn["train"], v, self.knn["key"], self.knn["k"], self.knn["classes"])
        if self.kernel is not None:
            from tablab.operators.kernels import predict_certified

            out = predict_certified(v, self.kernel)
        else:
            out = self.ml.transform(v)
        return _with_platt(out, self.platt) if self.platt else out

    @property
    def last_stage(self):
        return self.ml.stages[-1] if self.ml is not None else None


def _margin(i: int, n: int):
    """Margin of class i: of two classes the raw prediction of the second, its
    negative for the first; else the one-vs-rest margin."""
    raw = vector_to_array("rawPrediction")
    return F.element_at(raw, i + 1) if n != 2 else F.element_at(raw, 2) * (1.0 if i else -1.0)


PLATT_STEPS = 30


def _fit_platt(scored: DataFrame, n_classes: int) -> tuple[list, int, bool]:
    """(slope, intercept) per class, steps taken and whether they settled, of the logistic fit of membership on the
    margin over the training rows (Platt's smoothed targets): Newton steps for
    all classes together, partial sums by NumPy per batch; two classes share one fit."""
    own = [1] if n_classes == 2 else list(range(n_classes))
    rows = scored.select(*[_margin(i, n_classes).alias(f"m{i}") for i in own], "label").cache()
    try:
        n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
        count = {int(r["label"]): r["n"] for r in n}
        total = sum(count.values())
        fit = {i: np.zeros(2) for i in own}
        names = [f"{k}{i}" for i in own for k in ("ga", "gb", "aa", "ab", "bb")]
        steps, settled = 0, False
        while steps < PLATT_STEPS and not settled:
            steps += 1

            def partial(batches, fit=dict(fit)):
                sums = np.zeros(len(names))
                for pdf in batches:
                    for at, i in enumerate(own):
                        pos, neg = count.get(i, 0), total - count.get(i, 0)
                        y = np.where(pdf["label"] == i, (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0))
                        m = pdf[f"m{i}"].to_numpy()
                        p = 1.0 / (1.0 + np.exp(-np.clip(m * fit[i][0] + fit[i][1], -500, 500)))
                        w = p * (1 - p)
                        sums[5 * at : 5 * at + 5] += [((p - y) * m).sum(), (p - y).sum(), (w * m * m).sum(), (w * m).sum(), w.sum()]
                yield pd.DataFrame([sums], columns=names)

            row = one_row(rows.mapInPandas(partial, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]))
            move = 0.0
            for i in own:
                grad = np.array([row[f"ga{i}"], row[f"gb{i}"]], float)
                hess = np.array([[row[f"aa{i}"], row[f"ab{i}"]], [row[f"ab{i}"], row[f"bb{i}"]]], float) + 1e-9 * np.eye(2)
                step = np.linalg.solve(hess, grad)
                step *= min(1.0, 10.0 / max(1e-12, np.abs(step).max()))  # far from the optimum, not too far at once
                fit[i] = fit[i] - step
                move = max(move, float(np.abs(step).max()))
            settled = move < 1e-6
    finally:
        rows.unpersist()
    if n_classes == 2:  # the first class has the opposite margin, and the complement's probability
        a, b = fit[1].tolist()
        return [[a, -b], [a, b]], steps, settled
    return [fit[i].tolist() for i in own], steps, settled


def _fit_steps(model, name: str) -> list[tuple]:
    """(part, steps, most steps, converged) of the iterative fits that Spark ML keeps a history of; an SVM of several
    classes has one per class."""
    parts = model.models if hasattr(model, "models") else [model]
    out = []
    for i, part in enumerate(parts):
        if not getattr(part, "hasSummary", False) or not hasattr(part, "getMaxIter"):
            continue
        summary = part.summary() if callable(part.summary) else part.summary  # a method on some models, a property on others
        steps = int(summary.totalIterations)
        out.append((name if len(parts) == 1 else f"{name} class {i}", steps, part.getMaxIter(), steps < part.getMaxIter()))
    return out


def convergence(result: "TrainResult") -> DataFrame:
    """(part, steps, max_steps, converged) of every iterative fit of a model; no rows for models without one."""
    rows = result.model.fits if result.model else []
    return result.predictions.sparkSession.createDataFrame([tuple(r) for r in rows], "part string, steps int, max_steps int, converged boolean")


def _with_platt(scored: DataFrame, platt: list) -> DataFrame:
    """Add ``probability``: the logistic of each class's margin, summing to 1."""
    n = len(platt)
    p = F.array(*[1.0 / (1.0 + F.exp(-(F.lit(a) * _margin(i, n) + F.lit(b)))) for i, (a, b) in enumerate(platt)])
    scored = scored.withColumn("_p", p)
    total = F.aggregate("_p", F.lit(0.0), lambda acc, x: acc + x)
    return scored.withColumn("probability", F.transform("_p", lambda x: x / total)).drop("_p")


def certificates(result: "TrainResult") -> DataFrame:
    """(part, primal, dual, gap, passes, converged) of a model fitted with ``landmarks``: its objective exceeds the optimum by
    at most ``gap``.  No rows for other models."""
    found = (result.model.kernel or {}).get("certificates", []) if result.model else []
    rows = [(f"machine {i}", float(c["primal"]), float(c["dual"]), float(c["primal"] - c["dual"]), c["passes"], c["converged"]) for i, c in enumerate(found)]
    return result.predictions.sparkSession.createDataFrame(rows, "part string, primal double, dual double, gap double, passes int, converged boolean")


def _fit_landmarks(prep: Prepared, spec: ModelSpec, train: DataFrame, normalize: bool, seed: int) -> FittedModel:
    from tablab.operators import kernels as K

    scale_params = fit_standard(prep, train) if normalize else None
    p, classify = spec.params, spec.task == "classification"
    vec = _FeatureVector(prep.features, scale_params).transform(train).select(*dict.fromkeys([*prep.key, "features", "label"])).cache()
    try:
        points = K.choose_landmarks(vec, prep.key, int(p["landmarks"]), seed)
        dim = max(1, points.shape[1] if points.ndim == 2 else 1)
        kernel = p.get("kernel", "rbf")
        gamma = float(p["gamma"]) if "gamma" in p else rbf_gamma(vec, dim)
        m = K.landmark_map(points, kernel, gamma, int(p.get("degree", 3)), float(p.get("coef0", 0.0)))
        classes = [float(i) for i in range(len(prep.classes or []))] if classify else None
        if classify and len(classes) < 2:
            raise ValueError("an SVM needs at least two classes")
        fit = K.fit_certified(vec, m, classes, float(p.get("C", 1.0)), float(p.get("epsilon", 0.1)), float(p.get("tol", 0.01)), int(p.get("max_iter", 100)))
        fits = [(f"{spec.name} machine {i}", c["passes"], fit["max_passes"], c["converged"]) for i, c in enumerate(fit["certificates"])]
        platt = None
        if classify:
            platt, steps, settled = _fit_platt(K.predict_certified(vec, fit), len(classes))
            fits.append(("probabilities", steps, PLATT_STEPS, settled))
        return FittedModel(prep.features, scale_params, None, None, platt=platt, kernel=fit, fits=fits)
    finally:
        vec.unpersist()


#: Rows times trees that a forest grows at once: Spark keeps a number or three of each row for every tree that grows.
FOREST_CELLS = 200_000_000
#: Bytes of training rows, as a growing forest holds them, that one task reads at most.
FOREST_TASK_BYTES = 256_000_000


def _forest_groups(n: int, trees: int) -> int:
    return min(trees, math.ceil(n * trees / FOREST_CELLS))


def _forest_rows(rows: DataFrame, spec: ModelSpec, n: int, dim: int, trees: int) -> DataFrame:
    """The training rows in partitions that a forest's tasks can hold: every step reads a partition's binned features, its
    draws for each tree that grows and the nodes they stand in (two tables).  A split of a compressed file may have more
    rows than that and is dealt out again."""
    if spec.name != "random_forest":
        return rows
    most = max(1, FOREST_TASK_BYTES // (250 + 4 * dim + 12 * math.ceil(trees / max(1, _forest_groups(n, trees)))))
    if n <= most:
        return rows
    largest = one_row(rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")))["n"]
    return rows if largest <= most else rows.repartition(max(math.ceil(n / most), rows.sparkSession.sparkContext.defaultParallelism))


def _forest_grid(rows: DataFrame, spec: ModelSpec, n: int, dim: int) -> list | None:
    """The bin boundaries of a regression forest of many rows whose bins span few cells; None for every other model."""
    if (spec.name, spec.task) != ("random_forest", "regression") or 2**dim > GF.GRID_CELLS:
        return None
    forest = build_estimator(spec, n)[-1]
    if _forest_groups(n, forest.getNumTrees()) <= 1:
        return None
    edges = GF.bin_edges(rows, dim, forest.getMaxBins())
    return edges if GF.cells(edges) <= GF.GRID_CELLS else None


def _fit_stages(spec: ModelSpec, n: int, stats, seed: int, vec: DataFrame, edges: list | None = None) -> PipelineModel:
    """The fitted Spark ML stages.  A forest of many rows grows by the sums of its cells, if there are few, else in groups
    of trees, each group over all rows."""
    stages = build_estimator(spec, n, stats["k"], stats["sd"], seed)
    trees = stages[-1].getNumTrees() if spec.name == "random_forest" else 1
    if edges is not None:
        return PipelineModel(stages=[GF.fit(vec, stages[-1], edges, seed)])
    groups = _forest_groups(n, trees)
    if groups <= 1:
        return Pipeline(stages=stages).fit(vec)
    share = [trees // groups + (g < trees % groups) for g in range(groups)]
    grown = [stages[-1].copy().setNumTrees(m).setSeed(seed + g).fit(vec) for g, m in enumerate(share)]
    return PipelineModel(stages=[join_forests(vec.sparkSession, grown)])


def _fit_model(prep: Prepared, spec: ModelSpec, train: DataFrame, normalize: bool, seed: int) -> FittedModel:
    if spec.name in ("svm", "svr") and spec.params.get("landmarks") is not None:
        return _fit_landmarks(prep, spec, train, normalize, seed)
    scale_params = fit_standard(prep, train) if normalize else None
    base = _FeatureVector(prep.features, scale_params).transform(train).select("features", "label")
    kernelized = (spec.name == "svm" and spec.params.get("kernel", "rbf") == "rbf") or spec.name == "svr"
    mapped = kernelized and spec.name != "svr"  # the SVR maps its rows in every pass: many features a row would fill the disks
    if not mapped:
        base = base.cache()
    classes = F.countDistinct("label") if spec.task == "classification" else F.lit(0)
    stats = one_row(base.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sd"),
                             classes.alias("k"), F.max(F.size(vector_to_array("features"))).alias("d")))
    n, dim = max(1, stats["n"]), max(1, stats["d"] or 1)
    rff = rff_params(dim, rbf_gamma(base, dim), seed=seed) if kernelized else None
    edges = _forest_grid(base, spec, n, dim)
    vec = apply_rff(base, rff).cache() if mapped else base
    if edges is None and (dealt := _forest_rows(base, spec, n, dim, int(spec.params.get("n_estimators", 100)))) is not base:
        vec = dealt.cache()
        vec.count()
        base.unpersist()
    try:
        if spec.name == "svr":
            from tablab.operators.svr import fit_linear_svr

            w = fit_linear_svr(vec, rff=rff, C=float(spec.params.get("C", 1.0)), epsilon=float(spec.params.get("epsilon", 0.1)), max_iter=int(spec.params.get("max_iter", 60)))
            return FittedModel(prep.features, scale_params, rff, None, w, fits=[("svr", w["steps"], w["max_steps"], w["converged"])])
        ml = _fit_stages(spec, n, stats, seed, vec, edges)
        fits = _fit_steps(ml.stages[-1], spec.name)
        if spec.name == "random_forest":
            cut = cut_small_nodes(vec.sparkSession, ml.stages[-1], int(spec.params.get("min_samples_split", 2)))
            ml = PipelineModel(stages=[*ml.stages[:-1], cut])
        platt = None
        if spec.name == "svm":
            platt, steps, settled = _fit_platt(ml.transform(vec), int(stats["k"]))
            fits.append(("probabilities", steps, PLATT_STEPS, settled))
        return FittedModel(prep.features, scale_params, rff, ml, platt=platt, fits=fits)
    finally:
        vec.unpersist()


@dataclass
class TrainResult:
    model: FittedModel | None
    prepared: Prepared
    spec: ModelSpec
    train: DataFrame
    test: DataFrame
    predictions: DataFrame

    @property
    def scale_params(self):
        return self.model.scale_params if self.model else None

    def metrics(self) -> DataFrame:
        if self.spec.task == "classification":
            return M.classification_metrics(self.predictions)
        return M.regression_metrics(self.predictions)


def train_model(
    df: DataFrame,
    features: Sequence[str] | None,
    target: str,
    model: str = "random_forest",
    task: str | None = None,
    test_size: float = 0.2,
    normalize: bool = True,
    key: Sequence[str] | None = None,
    seed: int = 42,
    **params,
) -> TrainResult:
    """Prepare, split (hash of ``key``, default: the selected columns), fit on
    the training rows and predict the test rows."""
    prep = prepare_xy(df, features, target, key, task)
    spec = ModelSpec(model, prep.task, params)
    if spec.task == "classification" and model not in CLASSIFIERS:
        raise ValueError(f"classification models: {CLASSIFIERS}")
    if spec.task == "regression" and model not in REGRESSORS:
        raise ValueError(f"regression models: {REGRESSORS}")
    train, test = S.train_test_split(prep.df, prep.key, test_size, seed)
    fitted = _fit_knn(prep, train, normalize, params) if model == "knn" else _fit_model(prep, spec, train, normalize, seed)
    return TrainResult(fitted, prep, spec, train, test, with_class_names(fitted.transform(test), prep.class_codes))


def _fit_knn(prep: Prepared, train: DataFrame, normalize: bool, params: dict) -> FittedModel:
    fm = FittedModel(prep.features, fit_standard(prep, train) if normalize else None, None, None)
    classes = [float(i) for i in range(len(prep.classes or []))]
    rows = fm.vectors(train).select(*dict.fromkeys([*prep.key, "features", "label"]))
    fm.knn = {"train": rows, "key": prep.key, "k": int(params.get("n_neighbors", 5)), "classes": classes}
    return fm


def with_class_names(pred: DataFrame, class_codes: dict | None) -> DataFrame:
    """Add ``actual`` and ``predicted``: the target's own values of the label
    and the prediction (classification only)."""
    if class_codes is None or "label" not in pred.columns:
        return pred
    return pred.withColumn("actual", class_value(class_codes, "label")).withColumn("predicted", class_value(class_codes, "prediction"))


def class_value(class_codes: dict, c: str):
    """The target's own value of the class index in column ``c``."""
    names = F.array(*[F.lit(v) for v in class_codes["classes"]])
    return F.get(names, F.col(c).cast("int")).cast(class_codes.get("type", "string"))


def confusion(result: TrainResult) -> DataFrame:
    """(actual, predicted, n) over the test rows, in the target's own values."""
    return M.confusion_matrix(result.predictions, label="actual", prediction="predicted")


# --------------------------------------------------------------- M13
def cross_validate(prep: Prepared, model: str, k: int = 5, seed: int = 42, **params) -> DataFrame:
    """(fold, score) for K folds on the unscaled features: stratified folds
    and accuracy for classification, plain folds and R^2 for regression.
    Each fold's fit is itself distributed; the K scores are the only values
    collected.  Linear and ridge regression read the data once for all folds: a
    fold's rows come down to one matrix of products, and leaving a fold out is
    a subtraction."""
    if not 3 <= k <= 10:
        raise ValueError("k must be between 3 and 10")
    if prep.task == "regression" and model in ("linear", "ridge") and not _array_feature(prep.df, prep.features):
        return _cross_validate_linear(prep, k, seed, float(params.get("alpha", 1.0)) if model == "ridge" else 0.0)
    spec = ModelSpec(model, prep.task, params)
    if prep.task == "classification":
        folded = S.stratified_kfold(prep.df, prep.key, "label", k, seed)
    else:
        folded = S.kfold(prep.df, prep.key, k, seed)
    folded = folded.cache()
    scores = []
    try:
        for f in range(k):
            tr = folded.where(F.col("fold") != f).drop("fold")
            te = folded.where(F.col("fold") == f).drop("fold")
            fit = _fit_knn(prep, tr, False, params) if model == "knn" else _fit_model(prep, spec, tr, normalize=False, seed=seed)
            pred = fit.transform(te)
            if prep.task == "classification":
                s = one_row(M.classification_metrics(pred))["accuracy"]
            else:
                s = one_row(M.regression_metrics(pred))["r2"]
            scores.append((f, float(s) if s is not None else None))
    finally:
        folded.unpersist()
    return prep.df.sparkSession.createDataFrame(scores, "fold int, score double")


def _cross_validate_linear(prep: Prepared, k: int, seed: int, alpha: float) -> DataFrame:
    """The scores of :func:`cross_validate` from the products of (1, features, label) with themselves, one matrix per
    fold, added up by Spark.  Columns are centred by their means first, which keeps the differences of sums exact enough."""
    cols = [*prep.features, "label"]
    folded = S.kfold(prep.df, prep.key, k, seed, "__fold").select("__fold", *[q(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    means = one_row(folded.agg(*[F.avg(f"x{i}").alias(f"x{i}") for i in range(len(cols))]))
    spark = prep.df.sparkSession
    if means["x0"] is None:
        return spark.createDataFrame([(f, None) for f in range(k)], "fold int, score double")
    centre, d = np.array([means[f"x{i}"] for i in range(len(cols))]), len(cols) + 1

    def products(batches):
        total = np.zeros((k, d, d))
        for b in batches:
            v = np.column_stack([np.ones(len(b)), *(b.iloc[:, i + 1].to_numpy(float) - centre[i] for i in range(len(cols)))])
            for f in range(k):
                rows = v[b.iloc[:, 0].to_numpy() == f]
                total[f] += rows.T @ rows
        f, i, j = np.indices((k, d, d))
        yield pd.DataFrame({"f": f.ravel(), "i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    gram = np.zeros((k, d, d))
    for r in folded.mapInPandas(products, "f long, i long, j long, v double").groupBy("f", "i", "j").agg(F.sum("v").alias("v")).collect():
        gram[r["f"], r["i"], r["j"]] = r["v"]  # folds x columns x columns
    whole, scores = gram.sum(axis=0), []
    for f in range(k):
        g, t = whole - gram[f], gram[f]
        n, m = g[0, 0], t[0, 0]
        if n < 1 or m < 1:
            scores.append((f, None))
            continue
        mean = g[0, 1:] / n
        cov = g[1:, 1:] - n * np.outer(mean, mean)
        w = np.linalg.lstsq(cov[:-1, :-1] + alpha * np.eye(d - 2), cov[:-1, -1], rcond=None)[0]
        c = np.concatenate([[-(mean[-1] - w @ mean[:-1])], -w, [1.0]])  # label minus prediction, as weights of (1, x, y)
        spread = t[-1, -1] - t[0, -1] ** 2 / m
        scores.append((f, float(1 - (c @ t @ c) / spread) if spread > 0 else None))
    return spark.createDataFrame(scores, "fold int, score double")


def cv_summary(scores: DataFrame) -> DataFrame:
    """mean and population sd of the fold scores."""
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))


# ----------------------------------------------------------- M19 / M20
def coefficients(result: TrainResult) -> DataFrame:
    """(feature, coefficient) for linear / ridge models, by |coefficient|
    descending, with the intercept as feature '(intercept)'."""
    lm = result.model.last_stage if result.model else None
    if not hasattr(lm, "coefficients") or not hasattr(lm, "intercept"):
        raise ValueError("coefficients are reported for linear models only")
    names = result.prepared.features
    rows = [(n, float(c)) for n, c in zip(names, lm.coefficients.toArray())]
    spark = result.predictions.sparkSession
    df = spark.createDataFrame(rows + [("(intercept)", float(lm.intercept))], "feature string, coefficient double")
    return df.orderBy(F.abs("coefficient").desc())


def feature_importance(result: TrainResult) -> DataFrame:
    """(feature, importance) for forests, ascending (importances sum to 1)."""
    m = result.model.last_stage if result.model else None
    if not hasattr(m, "featureImportances"):
        raise ValueError("feature importance is reported for forests only")
    names = result.prepared.features
    imp = m.featureImportances.toArray()
    spark = result.predictions.sparkSession
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, imp)], "feature string, importance double").orderBy("importance")


def class_scores(result: TrainResult) -> DataFrame:
    """Long (row key..., label, cls, score) for ROC curves: the probability
    (or margin) of each class, ``cls`` being its index."""
    pred = result.predictions
    col = "probability" if "probability" in pred.columns else "rawPrediction"
    arr = F.col(col) if isinstance(pred.schema[col].dataType, T.ArrayType) else vector_to_array(col)
    key = [k for k in result.prepared.key if k != "label"]
    return pred.select(*key, "label", F.posexplode(arr).alias("cls", "score")).withColumn("cls", F.col("cls").cast("double"))


def roc_curves(result: TrainResult) -> DataFrame:
    """Binary: the curve of the positive (second) class; multiclass:
    one-vs-rest per class.  ``class_value`` is the target's own value."""
    s = class_scores(result)
    classes = result.prepared.classes or []
    if len(classes) == 2:
        s = s.where(F.col("cls") == 1.0)
    s = s.withColumn("is_pos", (F.col("label") == F.col("cls")).cast("int"))
    curve = M.roc_curve(s, label="is_pos", score="score", positive=1, keys=["cls"])
    names = F.array(*[F.lit(c) for c in classes]).cast("array<string>")
    return curve.withColumn("class_value", F.get(names, F.col("cls").cast("int")))


def save_model(result: TrainResult, path: str) -> None:
    """Save the Spark ML model plus every fitted constant (label codes,
    scaling, random-feature map, SVR weights) so a reload reproduces the
    predictions -- unlike a bare estimator dump, nothing is lost."""
    fm, spark = result.model, result.predictions.sparkSession
    if fm is not None and fm.ml is not None:
        fm.ml.write().overwrite().save(f"{path}/ml")
    if fm is not None and fm.knn is not None:
        fm.knn["train"].write.mode("overwrite").parquet(f"{path}/train")
    meta = {
        "features": result.prepared.features,
        "target": result.prepared.target,
        "task": result.prepared.task,
        "key": result.prepared.key,
        "feature_codes": {c: X.copy_code_table(spark, v, f"{path}/codes/{i}") for i, (c, v) in enumerate(result.prepared.feature_codes.items())},
        "class_codes": result.prepared.class_codes,
        "scale": fm.scale_params if fm else None,
        "rff": fm.rff if fm else None,
        "svr": fm.svr if fm else None,
        "platt": fm.platt if fm else None,
        "kernel": fm.kernel if fm else None,
        "knn": {k: v for k, v in fm.knn.items() if k != "train"} if fm and fm.knn else None,
        "spec": {"name": result.spec.name, "params": result.spec.params},
        "has_ml": bool(fm is not None and fm.ml is not None),
    }
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(spark, path: str) -> tuple[FittedModel, dict]:
    """(fitted model, metadata); ``model.transform(prepared_rows)`` predicts."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    ml = PipelineModel.load(f"{path}/ml") if meta["has_ml"] else None
    knn = meta.get("knn") and meta["knn"] | {"train": spark.read.parquet(f"{path}/train")}
    return FittedModel(meta["features"], meta["scale"], meta["rff"], ml, meta["svr"], meta.get("platt"), knn, meta.get("kernel")), meta


def encode_for_model(df: DataFrame, meta: dict) -> DataFrame:
    """Apply the saved label codes to new rows before ``transform``."""
    out = df
    for c, params in (meta.get("feature_codes") or {}).items():
        out = X.apply_label_encode(out, c, params)
    return out
