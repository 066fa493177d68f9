"""Importance resampling against scoring and sorting everything."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare, duck

from tablab.llm import resampling as R
from tablab.llm.queries import ORACLE, QUERIES


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(x.lower() if "A" <= x <= "Z" else x for x in text or ""))


def brute(docs, target, buckets, percent, least, max_words):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, max_words + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    big_s, big_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        f = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words_of(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    k = percent * len(able) // 100
    ranks = Counter()
    drawn = [(tuple(r), n + 1) for n, r in enumerate(able[:k])]
    rest = [(tuple(r), None) for r in able[k:]] + [(tuple(r), None) for r in out if r[1] < least]
    return sorted([(*r, n) for r, n in drawn + rest], key=str), ranks


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def sample(n, seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = ["The", "CAT", "naïve", "Ünder", "x1", "日本", "word", "other"]
    return [(int(i), " ,.-\t\n"[i % 6].join(rng.choice(vocabulary, 3 + i % 9))) for i in range(n)]


@pytest.mark.parametrize("max_words,percent,accuracy", [(1, 10, 10000), (2, 35, 100), (3, 100, 10000)])
def test_equals_sorting_everything(spark, max_words, percent, accuracy):
    docs = sample(400) + [(None, "the cat " * 4), (None, "the cat " * 4), (7, "a b c d e"), (400, None), (401, ""), (402, "... !!!")]
    target = ["the cat sat", None, "", "naïve 日本 cat"]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, row string")
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(df.repartition(5), aim, max_words=max_words, buckets=50, percent=percent, min_words=4, accuracy=accuracy)
    assert rows_of(got) == brute(docs, target, 50, percent, 4, max_words)[0]


def test_hot_scores_and_copies(spark):
    """A third of all rows are one document; the cutoff lies among them, and every drawn row has a rank of its own."""
    docs = [(5, "a b c")] * 300 + [(i, "a b c") for i in range(600)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = R.resample(df, spark.createDataFrame([("a",)], "text string"), buckets=10, percent=50, min_words=1).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 451))
    drawn, rest = [r for r in got if r["rank"]], [r for r in got if not r["rank"]]
    assert min(r.score for r in drawn) >= max(r.score for r in rest)


def test_bracket_widens_until_it_holds(spark):
    """Whatever the sketch says, counts decide."""
    scores = spark.range(1000).selectExpr("case when id < 990 then 0 else id end as score")
    for k in (1, 5, 10, 11, 500, 1000):
        low, high, above = R.bracket(scores, k, 1000, accuracy=3)
        kth = sorted((r.score for r in scores.collect()), reverse=True)[k - 1]
        assert low <= kth <= high and above == scores.where(f"score > {high}" if high != float("inf") else "false").count()


def test_nothing_to_draw(spark):
    aim = spark.createDataFrame([("a",)], "text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, aim).count() == 0
    few = spark.createDataFrame(sample(9), "doc_id long, text string")
    assert [r["rank"] for r in R.resample(few, aim.limit(0), min_words=1).collect()] == [None] * 9


def test_long_text_by_blocks(monkeypatch):
    text = "Word ordinary, naïve-日本 " * 3000 + "y" * 500
    n, whole = R.feature_buckets(text, 997, 3)
    monkeypatch.setattr(R, "BLOCK", 100)
    m, parts = R.feature_buckets(text, 997, 3)
    assert n == m == len(words_of(text)) and sorted(whole.tolist()) == sorted(parts.tolist())


def test_query_matches_sql(spark):
    ok, message = compare(QUERIES["op12_importance_resampling"](spark, "/root/testdata/sf0.1"), duck("/root/testdata/sf0.1"), ORACLE["op12_importance_resampling"])
    assert ok, message
