"""Phrase growth against counting everything."""

import re
from collections import Counter

import numpy as np
import pytest
from oracle import compare, duck
from pyspark.sql import functions as F

from tablab.llm import collocations as C
from tablab.llm.queries import ORACLE, QUERIES


def brute(rows, min_count, top, cover):
    f, out = {}, []
    for lang, text in rows:
        c = f.setdefault("und" if lang is None else lang, Counter())
        lower = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            for k in (1, 2, 3):
                c.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= min_count}
        n, kept = sum(a for p, a in c.items() if len(p) == 1), []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= cover * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            s, k = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng, rows = np.random.default_rng(5), []
    words = np.array(["New", "york", "city", "of", "the", "Île", "ß", "a", "b", "c\x00", "\x1c", "日本"])
    for i in range(150):
        some = words[np.minimum(rng.zipf(1.4, 60) - 1, len(words) - 1)]
        text = "".join(w + str(rng.choice([" ", " ", " ", "\t ", ", ", "\n", "\x0b", ". "])) for w in some)
        rows.append((["en", "de", None, "und"][i % 4 if i % 3 else 0], text + "new york city " * (i % 3)))
    return rows + [("en", None), ("en", ""), (None, "..., \n"), ("xx", "once only")]


@pytest.mark.parametrize("top,min_count", [(2000, 3), (3, 3), (1, 5)])
def test_growth_equals_counting_everything(spark, texts, top, min_count):
    df = spark.createDataFrame([(i % 7, x, t, 1) for i, (x, t) in enumerate(texts)], "doc_id long, lang string, text string, phrase int")
    assert rows_of(C.collocations(df, min_count=min_count, top=top)) == brute(texts, min_count, top, 50)


def test_several_rounds(spark, texts, monkeypatch):
    """With fine steps and few best phrases wanted, covered pairs leave too few survivors at first."""
    monkeypatch.setattr(C, "STEP", 1)
    thresholds, goals = C._thresholds, []
    monkeypatch.setattr(C, "_thresholds", lambda pairs, goal: goals.append(goal) or thresholds(pairs, goal if len(goals) > 1 else 1))
    df = spark.createDataFrame([(x, t) for x, t in texts], "lang string, text string")
    assert rows_of(C.collocations(df, min_count=3, top=4)) == brute(texts, 3, 4, 50)
    assert len(goals) > 1


def test_empty_and_two_words_only(spark, texts):
    df = spark.createDataFrame(texts, "lang string, text string")
    assert C.collocations(df.limit(0)).count() == 0 and C.collocations(df.where("lang = 'xx'")).count() == 0
    got = C.collocations(df, min_count=3, max_words=2)
    assert {len(r.phrase.split(" ")) for r in got.collect()} == {2}
    with pytest.raises(ValueError):
        C.collocations(df, max_words=4)


def test_long_texts_in_small_blocks(spark, texts, monkeypatch):
    whole = " ".join(t or "" for _, t in texts)
    monkeypatch.setattr(C, "BLOCK", 64)
    words = [w for b in C.word_blocks(whole) for w in b]
    monkeypatch.setattr(C, "BLOCK", 1 << 20)
    assert words == [w for b in C.word_blocks(whole) for w in b]
    stream = C._Stream(3, None)
    total = Counter()
    for at in range(0, len(words), 50):  # counted every 50 words: runs across rows are not lost
        stream.add("en", words[at : at + 50])
        for batch in stream.count():
            total.update(dict(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))
    want = Counter(b" ".join(words[i : i + 3]).decode() for i in range(len(words) - 2) if C._END not in words[i : i + 3])
    assert total == want
    long = spark.createDataFrame([("en", "lo ng " * 400_000 + "x" * 3_000_000)], "lang string, text string")
    assert rows_of(C.collocations(long)) == brute([("en", "lo ng " * 400_000 + "x" * 3_000_000)], 10, 2000, 50)


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(10**14, 10**14, 3 * 10**14 + 1)], "a long, l long, r long")
    assert df.select(C.score("a", "l", "r").alias("s")).first()["s"] == 10**6 * 10**28 // (10**14 * (3 * 10**14 + 1))


def test_bit_table_misses_nothing(spark):
    rows = [("en", f"w{i} v{i % 7}") for i in range(5000)]
    table = C.BitTable(spark.createDataFrame(rows, "lang string, phrase string"))
    hashes = [np.array([C.word_hash("en", p.split(" ")[j].encode()) for _, p in rows], np.uint64) for j in (0, 1)]
    assert table.has(hashes).all()
    assert table.has(hashes[::-1]).mean() < 0.2


def test_query_matches_sql(spark):
    ok, message = compare(QUERIES["op11_phrase_collocations"](spark, "/root/testdata/sf0.1"), duck("/root/testdata/sf0.1"), ORACLE["op11_phrase_collocations"])
    assert ok, message


def test_runs_are_counted_as_numbers_and_words_hashed_anew_on_a_clash(spark, texts, monkeypatch):
    """Strings of runs are neither shuffled nor made; two words that share a hash are never taken for one another."""
    df = spark.createDataFrame(texts, "lang string, text string")
    plain = df.selectExpr("coalesce(lang, 'und') as lang", "coalesce(text, '') as text")
    assert [t for _, t in C.count_runs(plain, 2).dtypes] == ["bigint"] * 3
    real = C.count_runs
    clash = lambda texts, k, counted=None, salt=0: real(texts, k, counted, salt).withColumn("h", F.col("h") % 2) if k == 1 and not salt else real(texts, k, counted, salt)
    monkeypatch.setattr(C, "count_runs", clash)
    words, salt = C.count_words(plain)
    assert salt == 1 and words.count() == words.select("h").distinct().count()
    assert rows_of(C.collocations(df, min_count=3)) == brute(texts, 3, 2000, 50)
