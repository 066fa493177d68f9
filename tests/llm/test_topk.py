"""Threshold algorithm against scoring everything."""

import math

import numpy as np
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from tablab.llm.queries import ORACLE, QUERIES
from tablab.llm.topk import SortedLists, top_k


def brute(rows, k, ask):
    whole = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for own, (q, a) in enumerate(whole):
        if ask(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for n, (c, b) in enumerate(whole) if n != own and len(a) == len(b))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.1"])
def test_query_matches_sql(spark, sf):
    ok, message = compare(QUERIES["op3_exact_top_k"](spark, sf), duck(sf), ORACLE["op3_exact_top_k"])
    assert ok, message


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 256]) for i in range(120)]  # many ties
    rows += [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [math.nan] * 4), (203, [math.inf, 0.0, 0.0, 0.0]), (None, [1.0] * 4),
             (204, [1.0, 2.0]), (210, []), (220, []), (0, rows[0][1]), (10, [0.5] * 4), (205, [0.0] * 4), (20, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    for blocks in (7, 8192):
        got = top_k(df, F.col("vec_id") % 10 == 0, 5, block_rows=blocks, query_rows=3)
        assert sorted(map(tuple, got.collect())) == brute(rows, 5, lambda q: q % 10 == 0)
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_search_stops_early_and_stays_exact():
    rng = np.random.default_rng(1)
    vectors = np.floor(rng.normal(size=(5000, 8)) ** 3 * 256).astype(np.int64)
    lists = SortedLists(np.arange(5000), vectors)
    total = 0
    for q in range(20):
        ids, scores, scored = lists.top(q, vectors[q], 5)
        all_scores = vectors @ vectors[q]
        want = [i for i in np.lexsort((np.arange(5000), -all_scores)) if i != q][:5]
        assert ids.tolist() == want and scores.tolist() == all_scores[want].tolist()
        total += scored
    assert total < 20 * 5000 * 0.6


def test_large_components_stay_exact():
    vectors = np.array([[1 << 29, 3], [1 << 29, 4], [(1 << 29) + 1, 0]], np.int64)
    ids, scores, _ = SortedLists(np.arange(3), vectors).top(9, np.array([(1 << 29) + 1, 1]), 3)
    assert ids.tolist() == [2, 1, 0] and scores[1] == (1 << 29) * ((1 << 29) + 1) + 4
    with pytest.raises(ValueError):
        SortedLists(np.arange(3), vectors << 10).top(9, vectors[0] << 10, 3)
