"""BPE transducer and decoder against the tokenizers library, and token counts against plain encoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablab.llm.bpe import Encoder, TextDecoder, Transducer, Vocabulary, merge_long, sufficient_lookahead
from tablab.llm.queries import QUERIES, vocabulary
from tablab.llm.token_counts import count_tokens, documents_token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def content():
    return vocabulary()


def test_ids_and_text_match_the_library(library, content):
    encoder = Encoder(Vocabulary(content))
    rng = random.Random(1)
    texts = ["", "a" * 60000, " " * 500 + "x", "x\n\n  y\t z", "don't we'll 'r 're 's", "<|endoftext|>a<|endoftext|> b <|endoftext|>",
             "\x1c\x1d a\x85b　c", "日本語テキスト" * 9000, "½²Ⅷ१ x", "=-" * 40000, "x" * 140000 + " y", "e.g., 3.14,a.b", "ab " * 50000]
    texts += ["".join(rng.choice(" \n\t'aehirstTHé日½²1.,!<|endoftext|>  \x1f_\U0001d400") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzetaoin") for _ in range(100000))]
    texts += ["".join("a" + chr(c) + "1" + chr(c) + " " + chr(c) for c in range(lo, lo + 997) if not 0xD800 <= c < 0xE000) for lo in range(0, 0x30000, 997)]
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, got, ref in zip(texts, encoder.encode_all(texts), want):
        ids = np.frombuffer(got, "<u4").tolist()
        assert ids == ref.ids, text[:50]
        decoder = TextDecoder(encoder.v)
        parts = [decoder.feed(ids[i : i + 7]) for i in range(0, min(len(ids), 5000), 7)]
        if len(ids) <= 5000:
            assert "".join(parts) + decoder.finish() == library.decode(ref.ids, skip_special_tokens=False)


def test_decoder_replaces_broken_bytes_like_the_library(library, content):
    v = Vocabulary(content)
    rng = random.Random(2)
    for _ in range(300):
        ids = [rng.randrange(256) if rng.random() < 0.7 else rng.randrange(50257) for _ in range(20)]
        decoder = TextDecoder(v)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def test_lookahead_is_sufficient(content):
    v = Vocabulary(content)
    rng = random.Random(3)
    for alphabet in (b"ab", b"etaoinshr", bytes(range(32, 127)), b"-=", b"0123456789"):
        data = bytes(rng.choice(alphabet) for _ in range(6000))
        run = Transducer(v, block=400)
        got = []
        for i in range(0, len(data), 37):
            got += run.feed(data[i : i + 37])
            assert len(run.held) <= 3 * run.block
        assert got + run.finish() == merge_long([v.first[b] for b in data], v.merge)


def test_lookahead_of_small_lists():
    assert sufficient_lookahead([]) == 0
    assert sufficient_lookahead([(b"a", b"b")]) == 1
    # c+d, then b+cd or b+c.. : a later input after "c" can move the boundary by c, b and a
    assert sufficient_lookahead([(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]) == 3


def test_digest_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, QUERIES["op2_bpe_encode_decode"](spark, SF).collect())) == sorted(want)


def test_token_count_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs)
    assert sorted(map(tuple, QUERIES["op4_token_counts"](spark, SF).collect())) == want


def test_odd_documents(spark, content):
    empty = hashlib.sha256(b"").hexdigest()
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "a <|endoftext|>", 3), (2, "x" * 90000, 4), (2, "", 5)], "doc_id long, text string, file int")
    from tablab.llm.bpe import token_digests

    rows = token_digests(docs, content).collect()
    assert [r.n_tokens for r in rows if r.ids_sha256 == empty] == [0, 0, 0]
    assert sorted(r.n_tokens for r in rows)[3] == 3
    counted = documents_token_counts(docs, content, 50256, block_bytes=1 << 10).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in counted)[:1] == [(0, 8)] and len(counted) == 5
    assert documents_token_counts(docs.limit(0), content, 50256).count() == 0
    assert token_digests(docs.limit(0), content).count() == 0


def test_scan_stitches_over_blocks(spark, tmp_path):
    rng = random.Random(4)
    files, want = [], []
    for k in range(5):
        lengths = [rng.choice([0, 0, 1, 2, 3, 30, 100]) for _ in range(rng.randint(0, 40))]
        ids = [x for n in lengths for x in [*[7] * n, 9]]
        want += [(k, i, n, True) for i, n in enumerate(lengths)]
        if k % 2:
            ids += [7] * k
            want.append((k, len(lengths), k, False))
        name = f"{tmp_path}/{k}.bin"
        open(name, "wb").write(np.array(ids, "<u2").tobytes())
        files.append(name)
    for block in (2, 16, 1 << 20):
        got = count_tokens(spark, files, 9, 2, block).collect()
        assert sorted((files.index(r.file), r.doc, r.n_tokens, r.closed) for r in got) == sorted(want)


def test_scan_tasks_follow_the_bytes(spark, tmp_path):
    """One file of 64 blocks is scanned by a task for each task size, adaptive execution or not."""
    path = tmp_path / "one.tokens"
    ids = np.random.default_rng(2).integers(0, 900, 1 << 19).astype("<u2")
    path.write_bytes(ids.tobytes())
    from tablab.llm import token_counts as C

    seen, plain = [], C.scan_blocks
    C.scan_blocks = lambda blocks, *a: seen.append(blocks.rdd.getNumPartitions()) or plain(blocks, *a)
    try:
        counts = count_tokens(spark, [str(path)], 7, block_bytes=1 << 14, task_bytes=1 << 14)
        assert counts.count() == (ids == 7).sum() + (ids[-1] != 7)
    finally:
        C.scan_blocks = plain
    assert seen == [64]
