"""Evaluation metrics (M14-M18, M21, M22), all computed as aggregates over a
predictions frame; nothing but the final numbers reaches the driver."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablab.functions.cumulative import running_sums, with_next
from tablab.functions.long import q
from tablab.functions.small import one_row
from tablab.operators import charts as G
from tablab.operators.reduction import sample_points


# ------------------------------------------------------------- M14 / M15
def label_pairs(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(actual, predicted, n): one row per observed pair (bounded by classes^2)."""
    return (
        pred.where(q(label).isNotNull() & q(prediction).isNotNull())
        .groupBy(q(label).alias("actual"), q(prediction).alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1
    (a class with no predictions or no support contributes 0)."""
    pairs = label_pairs(pred, label, prediction)
    per_actual = pairs.groupBy(F.col("actual").alias("cls")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("tp")
    )
    per_pred = pairs.groupBy(F.col("predicted").alias("cls")).agg(F.sum("n").alias("npred"))
    cls = per_actual.join(per_pred, "cls", "full").fillna(0, ["support", "tp", "npred"])
    prec = F.coalesce(F.try_divide(F.col("tp"), F.col("npred")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
    cls = cls.withColumn("p", prec).withColumn("r", rec).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0))
    )
    return cls.agg(
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        F.try_divide(F.sum(F.col("p") * F.col("support")), F.sum("support")).alias("precision"),
        F.try_divide(F.sum(F.col("r") * F.col("support")), F.sum("support")).alias("recall"),
        F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1"),
    )


def confusion_matrix(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Long (actual, predicted, n) over every pair of classes seen in either
    column, zero cells included.  The class list is aggregated into one array
    (bounded by the number of classes) and exploded twice -- no join of the
    data with itself."""
    pairs = label_pairs(pred, label, prediction)
    classes = pairs.select(F.col("actual").alias("c")).union(pairs.select(F.col("predicted").alias("c")))
    grid = (
        classes.agg(F.array_sort(F.collect_set("c")).alias("cs"))
        .select(F.explode("cs").alias("actual"), "cs")
        .select("actual", F.explode("cs").alias("predicted"))
    )
    return grid.join(pairs, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


# ------------------------------------------------------------- M16 / M17
def _score_counts(scores: DataFrame, label: str, score: str, positive, keys=()) -> DataFrame:
    pos = (q(label) == F.lit(positive)).cast("long")
    return scores.where(q(score).isNotNull() & q(label).isNotNull()).select(
        *[q(k) for k in keys], q(score).cast("double").alias("score"), pos.alias("pos"), (1 - pos).alias("neg")
    )


def roc_curve(scores: DataFrame, label: str = "label", score: str = "score", positive=1, keys=(), drop_intermediate: bool = False) -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, highest first, plus
    the starting point (inf, 0, 0).  Per ``keys`` (e.g. a class column for
    one-vs-rest curves) when given.  ``drop_intermediate`` leaves out points in
    the middle of equal steps (as many positives and as many negatives as the
    next score has), which lie on a straight line: same area, fewer points."""
    keys = list(keys)
    c = running_sums(_score_counts(scores, label, score, positive, keys), "score", ["pos", "neg"], keys, descending=True)
    if drop_intermediate:
        c = with_next(c, "score", ["pos", "neg"], keys, descending=True)
        even = (F.col("next_pos") == F.col("pos")) & (F.col("next_neg") == F.col("neg"))
        c = c.where(F.col("is_first") | F.col("next_pos").isNull() | ~even)
    pts = c.select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.col("total_neg")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("total_pos")).alias("tpr"),
    )
    start = c.select(*keys).distinct() if keys else scores.sparkSession.range(1).select()
    start = start.select(*keys, F.lit(math.inf).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def auc(scores: DataFrame, label: str = "label", score: str = "score", positive=1, keys=()) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule (ties count one half):
    sum over distinct scores of neg_s * (positives above s + pos_s / 2) / (P N)."""
    keys = list(keys)
    c = running_sums(_score_counts(scores, label, score, positive, keys), "score", ["pos", "neg"], keys, descending=True)
    term = F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0)
    agg = c.groupBy(*keys).agg(
        F.sum(term).alias("_s"), F.max("total_pos").alias("_p"), F.max("total_neg").alias("_n")
    )
    return agg.select(*keys, F.try_divide(F.col("_s"), F.col("_p") * F.col("_n")).alias("auc"))


# ------------------------------------------------------------- M18 / M21
def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: mse, rmse, mae, r2 (against the mean of the labels)."""
    e = q(label).cast("double") - q(prediction).cast("double")
    base = pred.where(q(label).isNotNull() & q(prediction).isNotNull())
    agg = base.agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(q(label).cast("double")).alias("_v")
    )
    return agg.select(
        "mse", F.sqrt("mse").alias("rmse"), "mae", (1 - F.try_divide(F.col("mse"), F.col("_v"))).alias("r2")
    )


def residual_data(pred: DataFrame, label: str = "label", prediction: str = "prediction", keep=(), max_points: int | None = None,
                  key=None, seed: int = 42) -> DataFrame:
    """(prediction, residual = label - prediction) per row; with ``max_points`` for a seeded sample of at most so many
    rows, which ``key`` identifies (by default ``keep``, label and prediction)."""
    if max_points is not None:
        pred = sample_points(pred, [*keep, label, prediction], max_points, (), key, seed)
    return pred.select(
        *[q(k) for k in keep],
        q(prediction).cast("double").alias("prediction"),
        (q(label).cast("double") - q(prediction).cast("double")).alias("residual"),
    )


def residual_distribution(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          bins: int = 30, curve_points: int = 200) -> DataFrame:
    """Residual histogram as a density (count / (n * width)) plus the normal
    density with the residuals' mean and population sd on ``curve_points``
    points over mean +- 4 sd.  Rows: (kind, x, y, x_end) with kind 'hist'
    (x = bin start, x_end = bin end) or 'normal'."""
    res = residual_data(pred, label, prediction)
    h = G.histogram_data(res, "residual", bins=bins, density=True)
    hist = h.select(F.lit("hist").alias("kind"), F.col("bin_start").alias("x"), F.col("density").alias("y"),
                    F.col("bin_end").alias("x_end"))
    m = one_row(res.agg(F.avg("residual").alias("mu"), F.stddev_pop("residual").alias("sd")))
    mu, sd = m["mu"], m["sd"]
    spark = pred.sparkSession
    if mu is None or not sd:
        return hist
    i = F.col("id").cast("double")
    x = F.lit(mu - 4 * sd) + i * F.lit(8 * sd / (curve_points - 1))
    pdf = F.exp(-0.5 * F.pow((x - F.lit(mu)) / F.lit(sd), 2)) / F.lit(sd * math.sqrt(2 * math.pi))
    normal = spark.range(curve_points).select(
        F.lit("normal").alias("kind"), x.alias("x"), pdf.alias("y"), F.lit(None).cast("double").alias("x_end")
    )
    return hist.unionByName(normal)
