"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt by hash into blocks of bounded size.  A block keeps one list per dimension, sorted by the component;
a query reads its lists in step -- from the top where its own component is positive, from the bottom where it is
negative -- and scores each vector in full when it first shows up.  The bound of everything unread is the inner product
of the query with the lists' current values: once the k-th best score exceeds it, no unread vector can enter (a vector
that ties with the k-th could, if its id is smaller, so an equal bound does not stop the search).  A block answers with
at most k rows per query, which a window per query merges.

Queries come in blocks too, so a task holds one block of each; only block members are paired, each pair of blocks by one
task.  Blocks are dealt by a hash of the row's number: equal or frequent vectors and ids spread like any others.

Components x become floor(256 * x); all arithmetic is on whole numbers and exact.  Defined results: vectors that are null
or hold null or non-finite components, and null ids, take no part; a candidate is a row: every row but the query's own counts,
rows with equal ids or repeated in full too, and each row that asks has its own answer; vectors are compared with vectors of their own length only; a query
without candidates has no rows; an inner product beyond 63 bits is an error; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablab.llm.common import materialise, ref

BLOCK_ROWS, QUERY_ROWS, FIRST_DEPTH = 8192, 2048, 32


class SortedLists:
    """A block of candidates with one sorted list per dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")  # places in id order, so ties go to the smaller place
        self.ids, self.vectors = ids[order], np.ascontiguousarray(vectors[order])
        self.rows = self.ids if rows is None else rows[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.copy()  # dimension -> places, ascending
        self.values = np.take_along_axis(self.vectors.T, self.order, axis=1)
        self.largest = int(np.abs(self.vectors).max(initial=0))

    def exact(self, query: np.ndarray) -> np.ndarray:
        """The candidates in a type in which products with ``query`` cannot be rounded."""
        most = len(query) * self.largest * int(np.abs(query).max(initial=0))
        if most >= 1 << 63:
            raise ValueError("an inner product may not fit 63 bits")
        if most >= 1 << 53:
            return self.vectors
        if not hasattr(self, "floats"):
            self.floats = self.vectors.astype(np.float64)
        return self.floats

    def top(self, query_row: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best (score descending, id ascending) but the query's own row, and how many candidates
        were scored."""
        n, table = len(self.ids), self.exact(query)
        q = query.astype(table.dtype)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        seen = np.zeros(n, bool)
        places, scores = np.empty(0, np.int64), np.empty(0, table.dtype)
        scored, read, depth = 0, 0, FIRST_DEPTH
        while True:
            depth = min(depth, n)
            near = np.concatenate([self.order[up, n - depth : n - read].ravel(), self.order[down, read:depth].ravel()])
            if depth == n:
                near = np.arange(n)
            fresh = np.zeros(n, bool)
            fresh[near] = True
            new = np.flatnonzero(fresh & ~seen)
            seen[new] = True
            new = new[self.rows[new] != query_row]
            if len(new):
                scored += len(new)
                places, scores = np.concatenate([places, new]), np.concatenate([scores, table[new] @ q])
                if len(places) > k:
                    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
                    may = np.flatnonzero(scores >= cut)
                    best = may[np.lexsort((places[may], -scores[may]))[:k]]
                    places, scores = places[best], scores[best]
            if depth == n:
                break
            bound = self.values[up, n - depth] @ q[up].astype(np.int64) + self.values[down, depth - 1] @ q[down].astype(np.int64)
            if len(places) == k and scores.min() > bound:
                break
            read, depth = depth, 2 * depth
        order = np.lexsort((places, -scores))
        return self.ids[places[order]], scores[order].astype(np.int64), scored


def whole(embedding: Column, scale: int = 256) -> Column:
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale))


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return embedding.isNotNull() & finite


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: int = 256, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates with the highest inner product for every row of ``vectors``
    that fulfils ``is_query`` (an expression over ``id_col``)."""
    rows = vectors.where(usable(ref(vector_col)) & ref(id_col).isNotNull()).select(
        ref(id_col).cast("long").alias("id"), is_query.alias("asks"), whole(ref(vector_col), scale).alias("v")
    )
    rows = materialise(rows.withColumn("d", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, asked = rows.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    blocks, groups = max(1, math.ceil(n / block_rows)), max(1, math.ceil(asked / query_rows))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    at = lambda m, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(m)).cast("int")
    left = rows.where("asks").select("d", at(groups, 1).alias("g"), each(blocks).alias("b"), "id", "v", "row")
    right = rows.select("d", each(groups).alias("g"), at(blocks, 2).alias("b"), "id", "v", "row")

    def matrix(t: pa.Table, d: int) -> np.ndarray:
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False) if t.num_rows and d else np.empty(0, np.int64)
        return flat.astype(np.int64, copy=False).reshape(t.num_rows, d)

    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if queries.num_rows and candidates.num_rows:
            d = queries.column("d")[0].as_py()
            lists = SortedLists(candidates.column("id").to_numpy(), matrix(candidates, d), candidates.column("row").to_numpy())
            asks, rows_of = matrix(queries, d), queries.column("row").to_numpy()
            for i, q in enumerate(queries.column("id").to_numpy()):
                ids, scores, _ = lists.top(int(rows_of[i]), asks[i], k)
                for c, x in zip(out, (np.full(len(ids), q), np.full(len(ids), rows_of[i]), ids, scores)):
                    c.append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in zip(("query_id", "row", "vec_id", "score"), out)})

    found = left.groupBy("d", "g", "b").cogroup(right.groupBy("d", "g", "b")).applyInArrow(run, "query_id long, row long, vec_id long, score long")
    best = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
