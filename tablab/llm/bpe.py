"""Byte-level BPE as a bounded-lookahead streaming transducer, and its decoder.

**Sufficient lookahead.**  Run the merges in rank order on a text and on an extension of it.  The two runs first differ
at the end of the shorter one.  A rule ``u v`` moves the leftmost difference ``len(u)`` bytes to the left, and the next
rule to move it must rank higher and have a right part that begins with ``u``.  So the difference never reaches further
left than the heaviest chain of such rules, which one pass over the merge list finds (``sufficient_lookahead``).  Tokens
that end at least that far before the end of what has been read are final: they are emitted and their bytes forgotten.

**Encoding** cuts a text into pre-tokens (no merge crosses them).  Short stretches between single spaces repeat a lot, so
their ids are kept in a cache of bounded size, and short pre-tokens new to it are merged many at a time in numpy; a long
pre-token goes through the transducer, which holds one block plus the lookahead whatever its length.  **Decoding** is a byte-to-text state machine fed block by block: an incremental UTF-8 decoder
that carries at most three bytes of an unfinished character and replaces each maximal invalid part by U+FFFD.

Defined results: a null text is an empty one and has no ids; special tokens found in a text become their ids unless
``specials=False``, which treats them as ordinary text; texts of any length are read whole.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tablab.llm.common import ref

#: White space and word classes of the pre-tokeniser's pattern (fixed values).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKEN = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: A stretch of text that no pre-token crosses: non-space characters with at most one blank before them, cut where a
#: letter or digit meets a full stop or comma, or blanks.
STRETCH = re.compile(rf" ?[^{SPACE}.,]++(?![.,])| ?[^{SPACE}.,]++(?<=[^\W_])| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SAFE_CUT = re.compile(rf"[^{SPACE}] (?=[^{SPACE}])")
#: Characters of a block, of a group of texts encoded together, of the longest stretch kept in the cache; stretches kept.
BLOCK, GROUP, CACHED, CACHE_SIZE = 1 << 16, 1 << 21, 64, 500_000
#: Pre-tokens of more bytes than this are merged one by one.
WIDE = 32
NEVER = 1 << 30


def byte_alphabet() -> dict[str, int]:
    """Character of the vocabulary file -> byte: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after which no later input can change a token boundary (see the module's text)."""
    reach: dict[bytes, int] = {}
    for u, v in merges:
        far = len(u) + max(reach.get(v[:k], 0) for k in range(1, len(v) + 1))
        if far > reach.get(u, 0):
            reach[u] = far
    return max(reach.values(), default=0)


class Vocabulary:
    """Merge rules and ids of a byte-level BPE file (content of a ``tokenizers`` JSON)."""

    def __init__(self, content: str | bytes):
        spec = json.loads(content)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only plain byte-level BPE files are supported")
        if model.get("dropout") or model.get("ignore_merges") or model.get("unk_token"):
            raise ValueError("dropout, ignore_merges and unknown tokens are not supported")
        back = byte_alphabet()
        to_bytes = lambda token: bytes(back[c] for c in token)
        self.special = {}
        for t in spec.get("added_tokens") or []:
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized"):
                raise ValueError(f"added token {t['content']!r} has options that are not supported")
            self.special[t["content"]] = t["id"]
        self.bytes_of = {i: t.encode() for t, i in self.special.items()}
        ids: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            if token not in self.special:
                ids[to_bytes(token)] = i
                self.bytes_of[i] = to_bytes(token)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(to_bytes(a), to_bytes(b)) for a, b in pairs]
        self.first = [ids[bytes([b])] for b in range(256)]
        made: dict[bytes, int] = {}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            # the lookahead's proof needs a token to exist before a rule uses it, made by one rule
            if any(len(x) > 1 and made.get(x, rank) >= rank for x in (a, b)) or a + b in made:
                raise ValueError("the merge list is not proper")
            made[a + b] = rank
            self.merge[ids[a], ids[b]] = rank, ids[a + b]
        self.lookahead = sufficient_lookahead(merges)
        self.width = max(self.bytes_of) + 1
        keys = np.array([a * self.width + b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        first = np.array(self.first)
        self.byte_rank = pair_ranks(self, np.repeat(first, 256), np.tile(first, 256))
        self.made = np.array([i for _, i in self.merge.values()], np.int32)
        self.special_pattern = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.table = [self.bytes_of.get(i, b"") for i in range(self.width)]


def merge_long(ids: list[int], rules: dict) -> list[int]:
    """All merges of one piece, the lowest rank first, then the leftmost, in O(n log n): a heap of (rank, place) over a
    linked list of parts."""
    n = len(ids)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(rules[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in rules]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not live[i] or j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], live[j] = rules[a, b][1], False
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for x, y in ((before[i], i), (i, k)):
            if x >= 0 and y < n and (r := rules.get((ids[x], ids[y]))):
                heapq.heappush(heap, (r[0], x, ids[x], ids[y]))
    return [t for t, ok in zip(ids, live) if ok]


def pair_ranks(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of each pair of ids, ``NEVER`` where no rule merges it."""
    if not len(v.keys):
        return np.full(a.shape, NEVER, np.int32)
    key = a.astype(np.int64) * v.width + b
    at = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
    return np.where(v.keys[at] == key, v.key_rank[at], np.int32(NEVER))


def merge_many(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """All merges of many short pieces at once.  Each step merges, in every piece that still can, its pair of lowest
    rank, leftmost first; all rows lose one column, so the matrix stays rectangular.  Ids come as ``<u4`` bytes."""
    out: list[bytes] = [b""] * len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    first = np.array(v.first, np.int32)
    for i in np.flatnonzero(sizes > WIDE).tolist():
        out[i] = np.array(merge_long([v.first[x] for x in pieces[i]], v.merge), "<u4").tobytes()
    for size in np.unique(sizes[sizes <= WIDE]):
        rows = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join([pieces[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), size)
        ids = first[raw]
        ranks = v.byte_rank[raw[:, :-1].astype(np.int32) << 8 | raw[:, 1:]]
        while len(rows):
            n, m = ids.shape
            at = ranks.argmin(axis=1) if m > 1 else np.zeros(n, np.int64)
            best = ranks[np.arange(n), at] if m > 1 else np.full(n, NEVER)
            stuck = best == NEVER
            final = ids[stuck].astype("<u4").tobytes()
            for k, i in enumerate(rows[stuck].tolist()):
                out[i] = final[4 * m * k : 4 * m * (k + 1)]
            go = ~stuck
            rows, ids, ranks, at, best = rows[go], ids[go], ranks[go], at[go], best[go]
            if not (n := len(rows)):
                break
            row = np.arange(n)
            ids[row, at] = v.made[best]
            keep = np.ones((n, m), bool)
            keep[row, at + 1] = False
            ids = ids[keep].reshape(n, m - 1)
            keep = np.ones((n, m - 1), bool)
            keep[row, at] = False
            ranks = ranks[keep].reshape(n, m - 2)
            for left in (at - 1, at):  # the two pairs that the new token is part of
                ok = (left >= 0) & (left < m - 2)
                r, c = row[ok], left[ok]
                ranks[r, c] = pair_ranks(v, ids[r, c], ids[r, c + 1])
    return out


class Transducer:
    """Bytes of one pre-token in, final token ids out; holds one block and the lookahead."""

    def __init__(self, vocabulary: Vocabulary, block: int = 1 << 14):
        self.v, self.block, self.held = vocabulary, max(block, vocabulary.lookahead + 1), b""

    def _merged(self) -> list[int]:
        return merge_long([self.v.first[b] for b in self.held], self.v.merge)

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(data), self.block):
            self.held += data[at : at + self.block]
            final, done = len(self.held) - self.v.lookahead, 0
            if final <= self.block // 2:
                continue
            for t in self._merged():
                size = len(self.v.bytes_of[t])
                if done + size > final:
                    break
                out.append(t)
                done += size
            self.held = self.held[done:]
        return out

    def finish(self) -> list[int]:
        out, self.held = (self._merged() if self.held else []), b""
        return out


class Encoder(dict):
    """Ids of texts.  As a dict it is the bounded cache: stretch -> its ids as little-endian uint32 bytes."""

    def __init__(self, vocabulary: Vocabulary, specials: bool = True, cache_size: int = CACHE_SIZE):
        super().__init__()
        self.v, self.limit = vocabulary, cache_size
        self.pattern = vocabulary.special_pattern if specials else None

    def _long_piece(self, piece: str) -> Iterator[bytes]:
        run = Transducer(self.v)
        for at in range(0, len(piece), BLOCK):
            yield np.array(run.feed(piece[at : at + BLOCK].encode()), "<u4").tobytes()
        yield np.array(run.finish(), "<u4").tobytes()

    def _learn(self, stretches: set[str]) -> None:
        """Put the ids of new stretches into the cache, all their new pre-tokens merged together."""
        need = {s for s in stretches if s.isalpha() or s[0] == " " and s[1:].isalpha()}  # one pre-token each
        cut = {s: PRETOKEN.findall(s) for s in stretches - need}
        need.update(chain.from_iterable(cut.values()))
        pieces = list(need - self.keys())
        self.update(zip(pieces, merge_many([p.encode() for p in pieces], self.v)))
        for s, parts in cut.items():
            self[s] = self[parts[0]] if len(parts) == 1 else b"".join([self[p] for p in parts])

    def __missing__(self, stretch: str) -> bytes:
        """Only stretches that are too long for the cache get here."""
        return b"".join(x for p in PRETOKEN.finditer(stretch) for x in self._long_piece(p[0]))

    def _known(self, stretches: list[str]) -> None:
        """After this, every given stretch that is short enough is in the cache."""
        used = set(stretches)
        new = used - self.keys()
        if len(self) + len(new) > self.limit:
            self.clear()
            new = used
        if new := {s for s in new if len(s) <= CACHED}:
            self._learn(new)

    def _joined(self, text: str) -> bytes:
        found = STRETCH.findall(text)
        self._known(found)
        return b"".join(map(self.__getitem__, found))

    def _blocks(self, text: str) -> Iterator[bytes]:
        at, n = 0, len(text)
        while at < n:
            end = n
            if at + BLOCK < n:  # cut before the first single blank between words from there on
                cut = SAFE_CUT.search(text, at + BLOCK)
                end = cut.start() + 1 if cut else n
            if end - at <= 2 * BLOCK:
                yield self._joined(text[at:end])
            else:  # no blank for long: pre-token by pre-token, each through the transducer
                for p in PRETOKEN.finditer(text, at, end) if end == n else PRETOKEN.finditer(text[at:end]):
                    yield from self._long_piece(p[0])
            at = end

    def blocks(self, text: str | None) -> Iterator[bytes]:
        """Ids of a text as little-endian uint32 bytes, block by block."""
        if not text:
            return
        at = 0
        for m in self.pattern.finditer(text) if self.pattern else ():
            yield from self._blocks(text[at : m.start()])
            yield np.array([self.v.special[m[0]]], "<u4").tobytes()
            at = m.end()
        yield from self._blocks(text[at:] if at else text)

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as bytes, in order.  Short texts are encoded a group at a time, long ones block by block."""
        group: list[str] = []
        held = 0
        for text in texts:
            text = text or ""
            plain = len(text) <= GROUP // 8 and not (self.pattern and self.pattern.search(text))
            if group and (not plain or held > GROUP):
                yield from self._group(group)
                group, held = [], 0
            if plain:
                group.append(text)
                held += len(text)
            else:
                yield b"".join(self.blocks(text))
        yield from self._group(group)

    def encode_column(self, column: pa.Array, rows: int = 512) -> Iterator[bytes]:
        """Ids of each text of an Arrow column; few texts at a time become Python strings."""
        for at in range(0, len(column), rows):
            yield from self.encode_all(column.slice(at, rows).to_pylist())

    def _group(self, texts: list[str]) -> Iterator[bytes]:
        found = [STRETCH.findall(t) for t in texts]
        self._known([s for f in found for s in f])
        for f in found:
            yield b"".join(map(self.__getitem__, f))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.blocks(text)), "<u4")


class TextDecoder:
    """Ids in, text out, block by block; holds the bytes of at most one unfinished character."""

    def __init__(self, vocabulary: Vocabulary):
        self.table = vocabulary.table
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.table.__getitem__, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


_LOADED: dict[tuple, object] = {}


def encoder_of(content: bytes, specials: bool = True) -> Encoder:
    """The encoder of a worker process: parsed once, its cache kept from batch to batch."""
    key = hash(content), specials
    if key not in _LOADED:
        _LOADED[key] = Encoder(Vocabulary(content), specials)
    return _LOADED[key]


def _digits(content: bytes) -> list[bytes]:
    """``,id`` of every id, as bytes."""
    if (key := (hash(content), "digits")) not in _LOADED:
        _LOADED[key] = [b",%d" % i for i in range(encoder_of(content).v.width)]
    return _LOADED[key]


def token_digests(docs: DataFrame, content: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text, and return per row: the id column, ``n_tokens``, ``ids_sha256`` (of the
    decimal ids joined by commas) and ``decoded_sha256`` (of the decoded text in UTF-8).

    One pass, no shuffle.  Both digests are fed block by block, so besides its text a document needs a block.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(content)  # size of the vocabulary file, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, digits = encoder_of(vocabulary.value), _digits(vocabulary.value)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for whole in encoder.encode_column(batch.column(1)):
                ids, n, decoder = hashlib.sha256(), 0, TextDecoder(encoder.v)
                text = hashlib.sha256()
                for at in range(0, len(whole), 4 * BLOCK):
                    block = np.frombuffer(whole, "<u4", min(BLOCK, (len(whole) - at) // 4), at).tolist()
                    joined = b"".join(map(digits.__getitem__, block))
                    ids.update(joined if n else joined[1:])
                    n += len(block)
                    text.update(decoder.feed(block).encode())
                text.update(decoder.finish().encode())
                counts.append(n)
                ids_sha.append(ids.hexdigest())
                text_sha.append(text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(ref(id_col).alias(id_col), ref(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
