"""``min_samples_split`` for fitted forests.

Spark bounds the rows of a leaf, not of a node that is split.  A tree grown without that bound holds, for every node, the
number of training rows that reached it (of the tree's own bootstrap sample, repeats included), and a rule on that number
cuts whole subtrees: a node with fewer rows than ``min_samples_split`` never splits, whatever grew below it.  Growing
first and cutting afterwards gives the same tree, since a node's split depends on its own rows only (feature subsets are
drawn per node, from the same seed, in both cases for the tree grown in full).

The cut works on the model as Spark ML persists it, a Parquet table with one row per node: a join-free projection on that
table, written beside the model's own metadata and loaded again."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablab.session import scratch_path


def tree_nodes(spark: SparkSession, model) -> DataFrame:
    """(tree, node, n_rows, prediction, left, right, feature, threshold, categories) of a fitted forest; children are -1
    in a leaf, a categorical split has the categories that go left instead of a threshold."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    n = lambda f: F.col(f"nodeData.{f}")
    numeric = (n("split.numCategories") == -1) & (n("split.featureIndex") >= 0)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n("id").alias("node"), n("rawCount").alias("n_rows"), n("prediction").alias("prediction"), n("leftChild").alias("left"),
        n("rightChild").alias("right"), n("split.featureIndex").alias("feature"), F.when(numeric, F.get(n("split.leftCategoriesOrThreshold"), 0)).alias("threshold"),
        F.when(n("split.numCategories") > 0, n("split.leftCategoriesOrThreshold")).alias("categories"),
    )


def cut_small_nodes(spark: SparkSession, model, min_samples_split: int):
    """The forest with every node of fewer than ``min_samples_split`` rows made a leaf (its class counts or mean stay)."""
    if min_samples_split <= 2:  # a node of two rows may split, one of one row cannot
        return model
    whole, cut = scratch_path(spark, "forest"), scratch_path(spark, "forest-cut")
    model.write().save(whole)
    nodes = spark.read.parquet(f"{whole}/data")
    small = F.col("nodeData.rawCount") < min_samples_split
    child = lambda side: F.when(small, F.lit(-1)).otherwise(F.col(f"nodeData.{side}"))
    data = F.col("nodeData").withField("leftChild", child("leftChild")).withField("rightChild", child("rightChild"))
    nodes.withColumn("nodeData", data).write.parquet(f"{cut}/data")
    spark.read.parquet(f"{whole}/treesMetadata").write.parquet(f"{cut}/treesMetadata")
    spark.read.text(f"{whole}/metadata").coalesce(1).write.text(f"{cut}/metadata")
    return type(model).load(cut)


def join_forests(spark: SparkSession, models: list):
    """One forest of the trees of all ``models``, which were fitted to the same rows."""
    paths = [scratch_path(spark, "forest") for _ in models]
    for model, path in zip(models, paths):
        model.write().save(path)
    first = [sum(m.getNumTrees for m in models[:i]) for i in range(len(models))]
    joined = scratch_path(spark, "forest-joined")
    for table in ("data", "treesMetadata"):
        parts = [spark.read.parquet(f"{p}/{table}") for p in paths]
        number = parts[0].columns[0]  # of the tree; only the table of nodes has a name for it
        parts = [t.withColumn(number, (F.col(number) + at).cast("int")) for t, at in zip(parts, first)]
        reduce(DataFrame.unionByName, parts).write.parquet(f"{joined}/{table}")
    meta = json.loads(spark.read.text(f"{paths[0]}/metadata").first()[0])
    meta["numTrees"] = meta["paramMap"]["numTrees"] = sum(m.getNumTrees for m in models)
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{joined}/metadata")
    return type(models[0]).load(joined)


def node_sizes(spark: SparkSession, model) -> DataFrame:
    """One row per tree: nodes reachable from the root, splits, and the fewest rows of a split node.  Nodes that a cut
    left behind are not reachable and do not count; depth is at most 30, and so are the steps."""
    nodes = tree_nodes(spark, model).checkpoint()
    level = nodes.where("node = 0")
    found = level
    while not level.where("left >= 0").isEmpty():
        below = level.where("left >= 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
        level = nodes.join(below, ["tree", "node"]).checkpoint()
        found = found.unionByName(level.select(*found.columns))
    split = F.col("left") >= 0
    return found.groupBy("tree").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(split).alias("n_splits"), F.min(F.when(split, F.col("n_rows"))).alias("least_rows"))
