"""Exact k-nearest-neighbour classification (M11), Euclidean distance,
uniform vote, distance ties broken by training key, vote ties -> smallest
class.

No cross join and no all-pairs enumeration by default: training points are
partitioned into cells around P pivots (the training points with the
smallest key hash), each cell keeps its radius R_c (largest distance of a
member to its pivot).  For a query q with pivot distances d_c:

1. candidates from q's nearest cell give a tentative k-th distance tau_q
   (+inf if that cell has fewer than k points);
2. by the triangle inequality every point of cell c is at least
   d_c - R_c away, so only cells with d_c - R_c <= tau_q can hold a true
   neighbour; those are equi-joined on (cell, sub-cell) and the global top-k
   is taken with a per-query window (planned with a partial group limit).

Cells larger than ``cell_target`` points are split into sub-cells by key
hash and the queries of a cell into blocks of ``query_target``, so a hot cell
is spread over many tasks on both sides.  Each (cell, sub-cell, query block)
is one cogroup task: NumPy computes distances a few queries at a time and
emits only every query's k best, so no (query, point) pair rows are ever
produced.  The result is exact: pruning only skips cells that cannot contain a
neighbour (the bound has a relative slack against rounding).

Query rows are told apart by an id of their own that is fixed by a checkpoint,
so rows that repeat a key are answered one by one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablab.functions.hashing import key_hash
from tablab.functions.literals import lit_array, lit_matrix
from tablab.functions.long import q
from tablab.functions.names import private
from tablab.functions.small import collect_bounded, one_row
from tablab.session import ensure_checkpoint_dir

MIN_PIVOTS, MAX_PIVOTS = 32, 512
CELL_TARGET = 100_000
QUERY_TARGET = 4096
#: Distances held at a time by a task.
BLOCK_PAIRS = 1 << 21
SLACK = 1e-9


def sq_dist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two double arrays, summed in index order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def as_double_array(df: DataFrame, features: str | Sequence[str]) -> Column:
    """A double array from a vector column, an array column or numeric columns."""
    if isinstance(features, str):
        dt = df.schema[features].dataType
        if isinstance(dt, T.ArrayType):
            return F.transform(F.col(features), lambda v: v.cast("double"))
        return vector_to_array(features)
    return F.array(*[F.col(c).cast("double") for c in features])


def _block_topk(k: int, key_names: list[str]):
    """cogroup function: queries x training points of one (cell, sub-cell);
    a matrix product finds every point that can be among a query's k best, and
    their distances are summed over dimensions in index order (the same
    rounding as the SQL definition); emits each query's k best (distance,
    training key) -- never the pairs themselves."""

    def fn(qpdf: pd.DataFrame, tpdf: pd.DataFrame) -> pd.DataFrame:
        cols = ["_qid", "_d", "_y"] + key_names
        if len(qpdf) == 0 or len(tpdf) == 0:
            return pd.DataFrame({c: [] for c in cols})
        qx = np.vstack(qpdf["_q"].to_numpy()).astype(float)
        # training rows in key order, so ties resolve to the smallest key
        tpdf = tpdf.sort_values(key_names, kind="stable")
        tx = np.vstack(tpdf["_x"].to_numpy()).astype(float)
        kk, step = min(k, len(tx)), max(1, BLOCK_PAIRS // len(tx))
        picked, dists, owners = [], [], []
        # products choose the candidates, with room for what products round off; the distances themselves follow the
        # definition.  Relative to a row of the block the numbers are small where the points are close
        centre = tx[0] if np.isfinite(tx[0]).all() else np.zeros(tx.shape[1])
        qc, tc = qx - centre, tx - centre
        tt = (tc * tc).sum(1)
        room = (tx.shape[1] + 8) * 16 * np.finfo(float).eps
        largest = tt.max()
        for at in range(0, len(qx), step):
            some = qc[at : at + step]
            with np.errstate(invalid="ignore"):
                near = some @ tc.T
                near *= -2.0
                near += tt
                slack = 2.0 * room * ((some * some).sum(1) + largest)
            kth = np.partition(near, kk - 1, axis=1)[:, kk - 1]
            sure = np.isfinite(kth) & np.isfinite(slack)
            for i, row in enumerate(near):
                idx = np.flatnonzero(row <= kth[i] + slack[i]) if sure[i] else np.arange(len(tx))
                own = np.zeros(len(idx))
                for j in range(qx.shape[1]):
                    diff = tx[idx, j] - qx[at + i, j]
                    diff *= diff
                    own += diff
                own = np.sqrt(own)
                best = np.argsort(own, kind="stable")[:kk]
                best = best[own[best] <= own[best[-1]]]  # none if a k-th distance is no number
                picked.append(idx[best]), dists.append(own[best]), owners.append(np.repeat(at + i, len(best)))
        sel = np.concatenate(picked)
        part = {"_qid": qpdf["_qid"].to_numpy()[np.concatenate(owners)], "_d": np.concatenate(dists)}
        return pd.DataFrame(part | {c: tpdf[c].to_numpy()[sel] for c in ["_y", *key_names]})

    return fn


def block_answers(k: int, key_names: list[str]):
    """:func:`_block_topk` on Arrow tables, every column with the type that the points have it in."""
    best = _block_topk(k, key_names)

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        members = points.select([*key_names, "_x"]).to_pandas()
        members["_y"] = np.arange(len(members))  # the place of the row: its values are taken from the table, nulls and all
        got = best(queries.select(["_qid", "_q"]).to_pandas(), members)
        at = pa.array(got["_y"].to_numpy(np.int64))
        own = {c: points.column(c).combine_chunks().take(at) for c in ("_y", *key_names)}
        return pa.table({"_qid": pa.array(got["_qid"].to_numpy(np.int64)), "_d": pa.array(got["_d"].to_numpy(float)), **own})

    return run


def _neighbors(train: DataFrame, te: DataFrame, train_key: Sequence[str], features, label: str, k: int,
               pivots: int | None, seed: int, cell_target: int, query_target: int) -> DataFrame:
    """(_qid, _rank, _t0.., _d, _y) for query rows ``te`` (_qid, _q)."""
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    tkn = [f"_t{i}" for i in range(len(train_key))]
    tr = train.select(*[F.col(c).alias(n) for c, n in zip(train_key, tkn)],
                      as_double_array(train, features).alias("_x"), F.col(label).alias("_y"),
                      key_hash(train_key, seed).alias("_h"))
    schema = "_qid long, _d double, _y " + train.schema[label].dataType.simpleString() + ", " + ", ".join(
        f"{n} {train.schema[c].dataType.simpleString()}" for c, n in zip(train_key, tkn)
    )
    n_train = one_row(tr.agg(F.count(F.lit(1)).alias("n")))["n"]
    pivots = pivots or min(MAX_PIVOTS, max(MIN_PIVOTS, int(math.sqrt(n_train) / 8)))

    # pivots: bounded sample chosen by key hash (deterministic, partition-independent)
    piv_rows = collect_bounded(tr.orderBy("_h", *tkn).select("_x").limit(pivots), pivots, "pivots")
    if not piv_rows:
        return spark.createDataFrame([], schema + ", _rank int")
    piv = lit_matrix([[float(v) for v in r["_x"]] for r in piv_rows])

    def pivot_dists(x: Column) -> Column:
        return F.transform(piv, lambda p: F.sqrt(sq_dist(x, p)))

    tr = tr.withColumn("_pd", pivot_dists(F.col("_x")))
    tr = tr.withColumn("_cell", F.array_position(F.col("_pd"), F.array_min("_pd")).cast("int") - 1)
    tr = tr.withColumn("_r", F.element_at("_pd", F.col("_cell") + 1)).drop("_pd").checkpoint()
    stats = collect_bounded(
        tr.groupBy("_cell").agg(F.max("_r").alias("R"), F.count(F.lit(1)).alias("n")), len(piv_rows), "cell stats"
    )
    radius = {r["_cell"]: float(r["R"]) for r in stats}
    subs = {r["_cell"]: max(1, math.ceil(r["n"] / cell_target)) for r in stats}
    n_cells = len(piv_rows)
    r_arr = lit_array([radius.get(c, -math.inf) for c in range(n_cells)])  # empty cell: never a candidate

    def per_cell(counts: dict[int, int]) -> Column:
        return F.element_at(F.array(*[F.lit(counts.get(c, 1)) for c in range(n_cells)]), F.col("_cell") + 1)

    points = tr.withColumn("_sub", F.pmod(F.col("_h"), per_cell(subs)).cast("int")).select("_cell", "_sub", *tkn, "_x", "_y")
    te = te.withColumn("_qd", pivot_dists(F.col("_q")))
    te = te.withColumn("_c0", F.array_position(F.col("_qd"), F.array_min("_qd")).cast("int") - 1).checkpoint()

    def candidates(asked: DataFrame) -> DataFrame:
        # asked: (_qid, _q, _cell) -> one task per (cell, sub-cell, block of queries)
        rows = collect_bounded(asked.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")), n_cells, "queries per cell")
        blocks = per_cell({r["_cell"]: max(1, math.ceil(r["n"] / query_target)) for r in rows})
        asked = asked.withColumn("_blk", F.pmod(F.xxhash64("_qid"), blocks).cast("int"))
        asked = asked.withColumn("_sub", F.explode(F.sequence(F.lit(0), per_cell(subs) - 1)))
        pts = points.withColumn("_blk", F.explode(F.sequence(F.lit(0), blocks - 1)))
        part = ["_cell", "_sub", "_blk"]
        return asked.groupBy(*part).cogroup(pts.groupBy(*part)).applyInArrow(block_answers(k, tkn), schema)

    def topk(c: DataFrame) -> DataFrame:
        w = Window.partitionBy("_qid").orderBy("_d", *tkn)
        return c.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)

    first = topk(candidates(te.select("_qid", "_q", F.col("_c0").alias("_cell")))).checkpoint()
    tau = first.groupBy("_qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("_d")).otherwise(F.lit(math.inf)).alias("_tau"))
    bound = F.col("_tau") + (F.abs("_tau") + F.col("_dc")) * SLACK
    rest = (
        te.join(tau, "_qid", "left")
        .withColumn("_tau", F.coalesce("_tau", F.lit(math.inf)))
        .select("_qid", "_q", "_c0", "_tau", F.posexplode("_qd").alias("_cell", "_dc"))
        .where((F.col("_cell") != F.col("_c0")) & (F.col("_dc") - F.element_at(r_arr, F.col("_cell") + 1) <= bound))
        .select("_qid", "_q", F.col("_cell").cast("int").alias("_cell"))
        .checkpoint()
    )
    return topk(first.drop("_rank").unionByName(candidates(rest)))


def _with_row_id(test: DataFrame, name: str) -> DataFrame:
    """Query rows under an id of their own, fixed by a checkpoint."""
    ensure_checkpoint_dir(test.sparkSession)
    return test.withColumn(name, F.monotonically_increasing_id()).checkpoint()


def knn_neighbors(
    train: DataFrame,
    test: DataFrame,
    train_key: Sequence[str],
    test_key: Sequence[str],
    features: str | Sequence[str] = "features",
    label: str = "label",
    k: int = 5,
    pivots: int | None = None,
    seed: int = 42,
    cell_target: int = CELL_TARGET,
    query_target: int = QUERY_TARGET,
) -> DataFrame:
    """(query key..., rank, neighbor_<train key>..., distance, label) for the
    k nearest training rows of every test row; test rows that repeat a key
    have their own k rows each."""
    (qid,) = private(test.columns, "qid")
    rows = _with_row_id(test, qid)
    te = rows.select(F.col(qid).alias("_qid"), as_double_array(rows, features).alias("_q"))
    best = _neighbors(train, te, list(train_key), features, label, k, pivots, seed, cell_target, query_target)
    tcols = [F.col(f"_t{i}").alias(f"neighbor_{c}") for i, c in enumerate(train_key)]
    own = [f"_k{i}" for i in range(len(test_key))]
    named = rows.select(F.col(qid).alias("_qid"), *[q(c).alias(n) for c, n in zip(test_key, own)])
    return best.join(named, "_qid").select(
        *[F.col(n).alias(c) for c, n in zip(test_key, own)], F.col("_rank").alias("rank"), *tcols, F.col("_d").alias("distance"), F.col("_y").alias(label)
    )


def _vote(neigh: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    votes = neigh.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_v"))
    return votes.groupBy(*keys).agg(
        F.min_by(F.col(label), F.struct((-F.col("_v")).alias("nv"), F.col(label).alias("l"))).alias("prediction"),
        F.map_from_entries(F.collect_list(F.struct(F.col(label), F.col("_v")))).alias("_votes"),
    )


def knn_vote(neigh: DataFrame, test_key: Sequence[str], label: str = "label") -> DataFrame:
    """(test key..., prediction): most frequent neighbour label, ties -> smallest.
    Keys must be unique per query row."""
    return _vote(neigh, test_key, label).drop("_votes")


def knn_classify(
    train: DataFrame,
    test: DataFrame,
    key: str | Sequence[str],
    features: str | Sequence[str] = "features",
    label: str = "label",
    k: int = 5,
    classes: Sequence | None = None,
    pivots: int | None = None,
    seed: int = 42,
    cell_target: int = CELL_TARGET,
    query_target: int = QUERY_TARGET,
) -> DataFrame:
    """Test rows with a ``prediction`` column (null if there is no training
    row) and, given the ``classes``, a ``probability`` array with each class's
    share of the votes; both replace test columns of these names."""
    keys = [key] if isinstance(key, str) else list(key)
    qid, votes, found = private(test.columns, "qid", "votes", "found")
    rows = _with_row_id(test, qid)
    te = rows.select(F.col(qid).alias("_qid"), as_double_array(rows, features).alias("_q"))
    best = _neighbors(train, te, keys, features, label, k, pivots, seed, cell_target, query_target)
    vote = _vote(best.select("_qid", F.col("_y").alias("_label")), ["_qid"], "_label")
    out = rows.join(vote.select(F.col("_qid").alias(qid), F.col("prediction").alias(found), F.col("_votes").alias(votes)), qid, "left")
    made = {"prediction": F.col(found)}
    if classes is not None:
        total = F.aggregate(F.map_values(votes), F.lit(0).cast("long"), lambda a, v: a + v)
        made["probability"] = F.array(*[F.coalesce(F.try_element_at(F.col(votes), F.lit(c).cast(train.schema[label].dataType)), F.lit(0)) / total for c in classes])
    return out.select(*[q(c) for c in test.columns if c.lower() not in made], *[v.alias(n) for n, v in made.items()])


def knn_predict(train_vec: DataFrame, test_vec: DataFrame, key: Sequence[str], k: int = 5, classes: Sequence | None = None) -> DataFrame:
    """Used by the supervised flow: vectors in ``features``, target in ``label``."""
    return knn_classify(train_vec, test_vec, list(key), "features", "label", k, classes).withColumn(
        "prediction", F.col("prediction").cast("double")
    )
