"""Silhouette with squared Euclidean distances for any number of clusters (U7), and a stratified estimate of it.

The mean squared distance from x to a cluster is ``|x|^2 - 2 x.m + q`` (m: its mean, q: its mean squared norm), so a point
needs one number per cluster.  Clusters come in blocks of bounded size; each block is a matrix that a pass over the points
multiplies with, keeping the smallest other distance so far and, in the block that holds it, the own one.  The passes are
projections of one stage, so the points are read once, and a block is never larger than ``BLOCK`` numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablab.functions.hashing import HASH_RANGE, key_hash
from tablab.functions.long import q

#: Numbers of a block of clusters, distances held at a time, and blocks after which the lineage is cut.
BLOCK, HELD, CHAIN = 1 << 20, 1 << 21, 16
#: Rows of a cluster that a sample takes at least (all of a smaller one).
LEAST = 10


def _points(df: DataFrame, features: str, col: str, noise: int, key: list[str]) -> DataFrame:
    kind = df.schema[features].dataType.simpleString()
    x = F.transform(q(features), lambda v: v.cast("double")) if kind.startswith("array") else vector_to_array(q(features))
    rows = df.select(q(col).cast("long").alias("c"), x.alias("x"), (key_hash(key, 42) if key else F.lit(0).cast("long")).alias("h"))
    return rows.where((F.col("c") != noise) & F.col("x").isNotNull())


def _cluster_blocks(points: DataFrame, width: int) -> list[DataFrame]:
    """(c, n, m, q) of all clusters, in blocks of about ``BLOCK`` numbers, dealt by a hash."""
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    sums = points.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg(norm).alias("q"), *[F.avg(F.get("x", F.lit(j))).alias(f"m{j}") for j in range(width)])
    sums = sums.checkpoint()
    blocks = max(1, math.ceil(sums.count() * (width + 3) / BLOCK))
    return [sums.where(F.pmod(F.xxhash64("c"), F.lit(blocks)) == i) for i in range(blocks)]


def _pass(rows: DataFrame, block: DataFrame, width: int) -> DataFrame:
    got = block.toPandas()  # about BLOCK numbers
    ids, order = np.sort(got["c"].to_numpy()), np.argsort(got["c"].to_numpy())
    size, square = got["n"].to_numpy(float)[order], got["q"].to_numpy(float)[order]
    means = got[[f"m{j}" for j in range(width)]].to_numpy(float)[order]
    step = max(1, HELD // max(1, len(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, near, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4))
            near, own = near.copy(), own.copy()
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for at in range(0, len(c) if len(ids) else 0, step):
                part = slice(at, at + step)
                v = x[part]
                d = np.maximum((v * v).sum(axis=1)[:, None] - 2 * v @ means.T + square, 0.0)
                place = np.minimum(np.searchsorted(ids, c[part]), len(ids) - 1)
                mine = np.flatnonzero(ids[place] == c[part])
                n = size[place[mine]]
                own[at + mine] = np.where(n > 1, d[mine, place[mine]] * n / np.maximum(n - 1, 1), -1.0)  # -1: alone
                d[mine, place[mine]] = np.inf
                near[part] = np.minimum(near[part], d.min(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(near), pa.array(own)], names=["c", "x", "h", "near", "own"])

    return rows.mapInArrow(run, "c long, x array<double>, h long, near double, own double")


def _scores(points: DataFrame, blocks: list[DataFrame], width: int) -> DataFrame:
    """(c, s): every point's silhouette; 0 for a point alone in its cluster."""
    rows = points.select("c", "x", "h", F.lit(float("inf")).alias("near"), F.lit(float("nan")).alias("own"))
    for i, block in enumerate(blocks):
        rows = _pass(rows, block, width)
        if i % CHAIN == CHAIN - 1:
            rows = rows.checkpoint()
    s = F.when(F.col("own") < 0, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("near") - F.col("own"), F.greatest("near", "own")), F.lit(0.0)))
    return rows.select("c", s.alias("s"))


def silhouette(df: DataFrame, features: str = "features", col: str = "cluster", noise: int = -1) -> DataFrame:
    """One row: silhouette, the exact mean over all points but noise; NULL with fewer than 2 clusters."""
    points = _points(df, features, col, noise, [])
    head = points.agg(F.max(F.size("x")).alias("d"), F.min("c").alias("a"), F.max("c").alias("b")).first()
    if head["d"] is None or head["a"] == head["b"]:
        return df.sparkSession.createDataFrame([(None,)], "silhouette double")
    return _scores(points, _cluster_blocks(points, head["d"]), head["d"]).agg(F.avg("s").alias("silhouette"))


def silhouette_estimate(df: DataFrame, key: str | list[str], sample: int, features: str = "features", col: str = "cluster", noise: int = -1) -> DataFrame:
    """One row: silhouette, std_error, n_sampled.  About ``sample`` points, chosen by hash of ``key`` within every
    cluster (in proportion, ``LEAST`` at least), are scored against the exact means of all clusters; cluster means of the
    scores are weighted by cluster size.  A cluster without a sampled point counts with the mean of the others."""
    points = _points(df, features, col, noise, [key] if isinstance(key, str) else list(key))
    head = points.agg(F.max(F.size("x")).alias("d"), F.min("c").alias("a"), F.max("c").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if head["d"] is None or head["a"] == head["b"]:
        return df.sparkSession.createDataFrame([(None, None, 0)], "silhouette double, std_error double, n_sampled bigint")
    sizes = points.groupBy(F.col("c").alias("k")).agg(F.count(F.lit(1)).alias("size"))
    share = F.greatest(F.lit(sample / head["n"]), F.lit(float(LEAST)) / F.col("size"))
    chosen = points.join(sizes, F.col("c") == F.col("k")).where(F.col("h") < share * HASH_RANGE).select("c", "x", "h")
    scores = _scores(chosen, _cluster_blocks(points, head["d"]), head["d"])
    by = scores.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("m"), F.var_samp("s").alias("v"))
    strata = by.join(sizes, F.col("c") == F.col("k"))
    weight = F.sum("size")
    return strata.agg(
        (F.sum(F.col("size") * F.col("m")) / weight).alias("silhouette"),
        (F.sqrt(F.sum(F.col("size") * F.col("size") * F.coalesce("v", F.lit(0.0)) / F.col("n") * (1 - F.col("n") / F.col("size")))) / weight).alias("std_error"),
        F.sum("n").alias("n_sampled"),
    )
