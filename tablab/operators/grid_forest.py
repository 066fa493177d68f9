"""Regression forests over a bounded grid of binned features.

A forest sees a row's features only as bins (``maxBins`` a feature at most).  Where the bins of all features span few cells,
a tree's growth needs no more than three sums over its bootstrap sample per cell: drawn copies, their labels and squared
labels.  One pass draws every tree's copies of every row (Poisson, as Spark's trees) and adds them up by cell; a node is
then a box of cells, and each tree grows in one task by the sums of its boxes: the split of largest variance gain among the
bin boundaries of all features, as Spark ML grows it row by row in a pass per level and group of trees.  The nodes are
written in the table that Spark ML persists a forest as, and loaded from there.

Bin boundaries: halfway between neighbouring values of a feature with at most ``maxBins`` of them, else quantiles over all rows."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablab.functions.small import one_row
from tablab.session import scratch_path

#: Cells that the bins of all features may span, cells times trees that a task adds up at once, and rows it draws from at a time.
GRID_CELLS, GRID_SUMS, DRAW_ROWS = 1 << 16, 1 << 22, 1 << 17
SUMS = "tree int, n binary, s binary, q binary"
NODES = "tree int, id int, n long, s double, q double, gain double, left int, right int, feature int, threshold double"


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def bin_edges(rows: DataFrame, dim: int, max_bins: int) -> list[np.ndarray]:
    """Ascending thresholds of each feature (``features`` <= threshold goes left), fewer than ``max_bins``."""
    x = rows.select(vector_to_array("features").alias("x"))

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.empty(0)] * dim
        for b in batches:
            m = _matrix(b, dim)
            for j in range(dim):
                if len(seen[j]) <= max_bins:
                    seen[j] = np.unique(np.concatenate([seen[j], m[:, j]]))[: max_bins + 1]
        f = np.repeat(np.arange(dim), [len(v) for v in seen])
        yield pa.RecordBatch.from_pydict({"f": pa.array(f, pa.int32()), "v": pa.array(np.concatenate(seen))})

    values: list[list[float]] = [[] for _ in range(dim)]
    for r in x.mapInArrow(few, "f int, v double").distinct().collect():  # at most max_bins + 1 a feature and task
        values[r["f"]].append(r["v"])
    edges = [np.unique(v) for v in values]
    many = [j for j in range(dim) if len(edges[j]) > max_bins]
    if many:
        shares = F.array(*[F.lit(i / max_bins) for i in range(1, max_bins)])
        found = one_row(x.agg(*[F.percentile_approx(F.element_at("x", j + 1), shares, 10_000).alias(f"f{j}") for j in many]))
    return [np.unique(found[f"f{j}"]) if j in many else (v[1:] + v[:-1]) / 2 for j, v in enumerate(edges)]


def cells(edges: list[np.ndarray]) -> int:
    return math.prod(len(e) + 1 for e in edges)


def _cell_sums(rows: DataFrame, edges: list[np.ndarray], trees: range, bootstrap: bool, centre: float, seed: int) -> DataFrame:
    """(tree, n, s, q): a task's sums of each tree by cell, of labels less ``centre``."""
    dim, shape = len(edges), [len(e) + 1 for e in edges]
    size = math.prod(shape)

    def draw(x: np.ndarray, y: np.ndarray, part: int, at: int, total: np.ndarray) -> None:
        place = np.ravel_multi_index([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], shape)
        order = np.argsort(place.astype(np.uint16 if size <= 1 << 16 else np.int64), kind="stable")
        y, place = y[order], place[order]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        held = place[first]
        for i, t in enumerate(trees):
            rng = np.random.default_rng([seed, t, part, at])
            w = np.bincount(rng.integers(0, len(y), rng.poisson(len(y)), dtype=np.int32), minlength=len(y)) if bootstrap else np.ones(len(y))
            total[0, i, held] += np.add.reduceat(w, first)
            v = w * y
            total[1, i, held] += np.add.reduceat(v, first)
            v *= y
            total[2, i, held] += np.add.reduceat(v, first)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, part, at, waiting, n = np.zeros((3, len(trees), size)), TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            if b.num_rows:
                waiting.append((_matrix(b, dim), b.column("label").to_numpy(zero_copy_only=False) - centre))
                n += b.num_rows
            if n >= DRAW_ROWS:
                draw(*(np.concatenate(v) for v in zip(*waiting)), part, at, total)
                waiting, n, at = [], 0, at + 1
        if waiting:
            draw(*(np.concatenate(v) for v in zip(*waiting)), part, at, total)
        for i, t in enumerate(trees):
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32())} | {c: pa.array([total[j, i].tobytes()], pa.binary()) for j, c in enumerate("nsq")})

    return rows.select(vector_to_array("features").alias("x"), "label").mapInArrow(add, SUMS)


def _variance(n, s, q):
    return np.maximum(q / n - (s / n) ** 2, 0.0)


def _best_split(box: np.ndarray, least: int) -> tuple[float, int, int]:
    """(gain, feature, bins that go left) of the best split of a box of cells (sums, feature 1, ...); gain 0: none."""
    n, s, q = box.reshape(3, -1).sum(1)
    whole, best = _variance(n, s, q), (0.0, -1, -1)
    for j in range(box.ndim - 1):
        by = box.sum(axis=tuple(i for i in range(1, box.ndim) if i != j + 1))
        left = np.cumsum(by, axis=1)[:, :-1]
        right = np.array([[n], [s], [q]]) - left
        ok = (left[0] >= least) & (right[0] >= least)
        if not ok.any():
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = whole - (left[0] * _variance(*left) + right[0] * _variance(*right)) / n
        gain = np.where(ok, gain, -np.inf)
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), j, at + 1)
    return best


def grow(sums: np.ndarray, edges: list[np.ndarray], depth: int, least: int) -> list[tuple]:
    """The nodes of a tree in pre-order: (id, n, s, q, gain, left, right, feature, threshold), by (sums, feature 1, ...)."""
    nodes: list = []

    def visit(box: np.ndarray, corner: tuple[int, ...], level: int) -> int:
        at = len(nodes)
        nodes.append(None)
        n, s, q = box.reshape(3, -1).sum(1)
        gain, j, cut = _best_split(box, least) if level < depth and n > 0 else (0.0, -1, -1)
        node = (at, int(n), s, q, -1.0, -1, -1, -1, None)
        if j >= 0:
            parts = [slice(None)] * box.ndim
            parts[j + 1] = slice(0, cut)
            left = visit(box[tuple(parts)], corner, level + 1)
            parts[j + 1] = slice(cut, None)
            moved = tuple(v + cut if i == j else v for i, v in enumerate(corner))
            right = visit(box[tuple(parts)], moved, level + 1)
            node = (at, int(n), s, q, gain, left, right, j, float(edges[j][corner[j] + cut - 1]))
        nodes[at] = node
        return at

    visit(sums, (0,) * len(edges), 0)
    return nodes


def fit(rows: DataFrame, estimator: RandomForestRegressor, edges: list[np.ndarray], seed: int) -> RandomForestRegressionModel:
    """``estimator`` fitted to (features, label), all features tried at every split."""
    spark = rows.sparkSession
    trees, depth, least = estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getMinInstancesPerNode()
    shape = [len(e) + 1 for e in edges]
    centre = one_row(rows.agg(F.avg("label").alias("m")))["m"]
    rows = rows.coalesce(2 * spark.sparkContext.defaultParallelism)  # a task's sums are as large as they are for all rows
    together = max(1, GRID_SUMS // cells(edges))

    def grown(table: pa.Table) -> pa.Table:
        total = np.zeros((3, math.prod(shape)))
        for j, c in enumerate("nsq"):
            for v in table.column(c):
                total[j] += np.frombuffer(v.as_buffer())
        got = [*zip(*grow(total.reshape(3, *shape), edges, depth, least))]
        kinds = [pa.int32(), pa.int64(), *[pa.float64()] * 3, *[pa.int32()] * 3, pa.float64()]
        tree = pa.array([table.column("tree")[0].as_py()] * len(got[0]), pa.int32())
        return pa.Table.from_arrays([tree, *(pa.array(v, t) for v, t in zip(got, kinds))], names=[c.split()[0] for c in NODES.split(", ")])

    path = scratch_path(spark, "forest")
    for at in range(0, trees, together):
        part = _cell_sums(rows, edges, range(at, min(trees, at + together)), estimator.getBootstrap(), centre, seed)
        _write_nodes(part.groupBy("tree").applyInArrow(grown, NODES), centre, f"{path}/data")
    _write_metadata(spark, estimator, len(edges), path)
    return RandomForestRegressionModel.load(path)


def _write_nodes(nodes: DataFrame, centre: float, path: str) -> None:
    n, s, q, m = F.col("n").cast("double"), F.col("s"), F.col("q"), F.lit(centre)
    mean = F.coalesce(F.try_divide(s, n), F.lit(0.0))
    inner = F.col("feature") >= 0
    split = F.struct(
        F.col("feature").alias("featureIndex"), F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories")
    )
    data = F.struct(
        F.col("id"), (mean + m).alias("prediction"), F.greatest(F.coalesce(F.try_divide(q, n), F.lit(0.0)) - mean * mean, F.lit(0.0)).alias("impurity"),
        F.array(n, s + n * m, q + 2 * m * s + n * m * m).alias("impurityStats"), F.col("n").alias("rawCount"), "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
    )
    nodes.select(F.col("tree").alias("treeID"), data.alias("nodeData")).write.mode("append").parquet(path)


def _write_metadata(spark, estimator: RandomForestRegressor, dim: int, path: str) -> None:
    """The metadata of a forest with the same parameters, grown on two rows, for as many trees and features as this one has."""
    rows = spark.createDataFrame([(Vectors.dense([float(v)] * dim), float(v)) for v in (0, 1)], ["features", "label"])
    like = scratch_path(spark, "forest")
    estimator.copy().setNumTrees(1).fit(rows).write().save(like)
    trees = estimator.getNumTrees()
    number, *rest = spark.read.parquet(f"{like}/treesMetadata").columns
    one = spark.read.parquet(f"{like}/treesMetadata")
    one.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias(number), *rest).write.parquet(f"{path}/treesMetadata")
    meta = json.loads(spark.read.text(f"{like}/metadata").first()[0])
    meta["numTrees"] = meta["paramMap"]["numTrees"] = trees
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")
