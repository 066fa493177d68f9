"""Substring deduplication against a dictionary of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tablab.llm.queries import QUERIES
from tablab.llm.substrings import extended, levels, remove_repeats, repeated_spans

SF = "/root/testdata/sf0.001"


def brute(texts, window):
    """texts: list; (n_words, n_removed, kept) of each."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d.doc_id, n, r, hashlib.sha256(k.encode()).hexdigest()) for d, (n, r, k) in zip(docs, brute([d.text for d in docs], 35)))
    got = sorted(tuple(r) for r in QUERIES["op8_substring_dedup"](spark, sf).collect())
    assert got == want


@pytest.mark.parametrize("window", [1, 2, 5, 24, 25, 60])
def test_random_texts(spark, window):
    rng = random.Random(window)
    vocabulary = [f"w{i}" for i in range(3 if window > 20 else 40)] + ["é", "日本"]
    passage = [[rng.choice(vocabulary) for _ in range(window + rng.randint(-2, 20) if window > 2 else 4)] for _ in range(5)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += [f"u{rng.random()}" for _ in range(rng.randint(0, 6))] + rng.choice(passage)
        texts.append("".join(p + rng.choice([" ", "\n", "  ", "\t"]) for p in parts))
    texts += [texts[0], texts[1], None, "", "  \n", None, "one", "one", "a " * (3 * window)]
    docs = spark.createDataFrame([(i % 7 if i % 5 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    want = brute(texts, window)
    changed = {t: (n, r, k) for t, (n, r, k) in zip(texts, want) if r}
    keys = {hashlib.md5((t or "").encode()).digest(): v for t, v in changed.items()}
    got = {bytes(r.key): (r.n_words, r.n_removed, r.kept) for r in repeated_spans(docs, window=window).collect()}
    assert got == keys
    after = remove_repeats(docs, window=window)
    assert after.columns == docs.columns
    assert sorted(str(r.text) for r in after.collect()) == sorted(str(k if r else t) for t, (_, r, k) in zip(texts, want))


def test_empty_and_very_long(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert repeated_spans(docs).count() == 0 and remove_repeats(docs).count() == 0
    text = " ".join(str(i) for i in range(300_000)) + " " + " ".join(str(i) for i in range(1000, 1040))
    (row,) = repeated_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_words, row.n_removed) == (300_040, 80)
    assert [tuple(s) for s in row.spans] == [(1000, 1040), (300_000, 300_040)]


def test_levels_and_extension():
    assert levels(35) == [18, 35] and levels(24) == [12, 24] and levels(1) == [1] and levels(100) == [13, 25, 50, 100]
    assert extended(np.array([9, 2]), 2, 4, 12).tolist() == [0, 1, 2, 7, 8]
    assert extended(np.array([0]), 2, 4, 3).tolist() == []
