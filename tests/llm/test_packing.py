"""Packing against piece-by-piece best fit and against plain encoding."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablab.llm.packing import assign, pack_documents, pack_runs
from tablab.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


def gaps_of(plan, capacity):
    used = defaultdict(list)
    for length, _, count, sequence, offset in plan.tolist():
        for i in range(count):
            used[sequence + i].append((offset, length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return sorted(capacity - sum(n for _, n in p) for p in used.values())


@pytest.mark.parametrize("seed", range(30))
def test_runs_give_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 20, 64])
    top = rng.randint(1, capacity)
    lengths = [rng.randint(1, top) for _ in range(rng.randint(0, 120))] + [rng.randint(1, capacity)] * rng.choice([0, 50])
    plan = pack_runs(Counter(lengths), capacity)
    for n, count in Counter(lengths).items():
        ranks = sorted(x for a, r, c, *_ in plan.tolist() if a == n for x in range(r, r + c))
        assert ranks == list(range(count))
    assert gaps_of(plan, capacity) == best_fit_decreasing(lengths, capacity)


def check(rows, texts, capacity=1024):
    """rows of the result; texts: multiset of (doc_id, text)."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for k, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[k, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for places in filled.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(filled) == len(best_fit_decreasing([r.length for r in rows], capacity))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check(QUERIES["op10_best_fit_packing"](spark, SF).collect(), docs)


def test_odd_documents(spark):
    rows = [(1, None, 1), (2, "", 2), (2, "", 2), (None, "one two", 3), (5, "word " * 5000, 4), (6, "x " * 1023, 5), (7, "a" * 9000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    check(pack_documents(docs, vocabulary()).collect(), [r[:2] for r in rows])
    assert pack_documents(docs.limit(0), vocabulary()).count() == 0


def test_one_length_for_all(spark):
    pieces = spark.range(3000).selectExpr("id", "cast(300 as long) length")
    got = assign(pieces, 1024).collect()
    assert len({r.sequence_id for r in got}) == 1000 and Counter(r.offset for r in got) == {0: 1000, 300: 1000, 600: 1000}


def test_ids_are_those_of_the_transducer():
    from tablab.llm.bpe import Encoder, Vocabulary
    from tablab.llm.packing import library_encoder

    rng = random.Random(8)
    texts = ["", None, "a" * 30000, " " * 30000 + "x", "\n" * 9999, "<|endoftext|> a<|endoftext|>", "don't 'll 12½²"]
    texts += ["".join(rng.choice(" \n\t'aehirstTHé日½²1.,!<|endoftext|>  \x1f_\U0001d400") for _ in range(rng.randint(1, 80))) for _ in range(500)]
    content = vocabulary()
    own, library = Encoder(Vocabulary(content)), library_encoder(content)
    assert [library(t) for t in texts] == list(own.encode_all(texts))


def test_white_space_beyond_the_librarys_stack():
    from tablab.llm.bpe import Encoder, Vocabulary
    from tablab.llm.packing import BLANK, library_encoder

    content = vocabulary()
    encode, library = library_encoder(content), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own = Encoder(Vocabulary(content))
    for run in (" ", "\n", " \n"):
        text = "a  b" + run * (2_000_000 // len(run)) + "x<|endoftext|>y"
        assert encode(text) == own.encode(text).tobytes()
    for n in (BLANK, 2 * BLANK - 2, 2 * BLANK - 1, 2 * BLANK):  # both sides of the switch
        text = "x" + "\n" * n + "y"
        assert np.frombuffer(encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
