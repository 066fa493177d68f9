"""Phrase collocations by best-first branch-and-bound growth.

A text is split at punctuation into pieces and those into words; phrases of 2 or 3 words that occur at least
``min_count`` times in a language are candidates, scored by their weakest cut: ``floor(10**6 * a * a / (l * r))``.  A
candidate goes if a longer one that contains it holds at least ``cover_percent`` of its occurrences.  The best ``top`` of
each language are returned.

*Growth.*  Words and word pairs are counted for the whole corpus.  A pair ``p = w1 w2`` bounds everything that grows
from it: with ``a <= f(p)`` and ``a <= f(w2 w3)`` the first cut gives score <= ``10**6 * f(p) / f(w1)``, and the pair's own
score is no larger.  Each round takes the nodes of best bound, down to a threshold per language, and counts the triples
that extend them on either side (those on the right can score, those on both sides can cover the pair).  All with a score
of at least the threshold is then settled: if ``top`` survivors reach it, ties included, the language is done; otherwise
the threshold falls to reach four times as many pairs and only the new nodes are grown.  At threshold 0 nothing is left.

*Counting* is one pass over the texts per level or round: tasks turn about a million words at a time into numbers,
count equal runs by sorting, and emit each run once, so a word or passage however frequent is added up before any shuffle.
Which runs are counted is decided by bit tables of at most 4 MB (frequent words, frequent pairs, nodes to grow): a false
hit only counts a run too many, each run is counted wholly or not at all, so counts stay exact whatever the corpus.
Texts of any length are read in blocks; runs across blocks are not lost.

Runs of several words are counted by the 64-bit hashes of their words, not as strings: three or four whole numbers a row.
No two words of the corpus share a hash (all words are compared first; on a clash they are hashed anew under another seed), so
counts stay exact, and the few runs that are frequent get their words back by a join.

Every join that meets a pair or word is ``common.join_facts``: a word in a third of all pairs is no single task.

Arithmetic is exact in 38 decimal digits (counts below 10**15).

Defined results: a null text is an empty one; a null language is ``und`` (and meets documents that say so); rows with
repeated texts or ids count each; ties go by count, then phrase in UTF-8 order; an empty table, or one without candidates,
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablab.llm.common import join_facts, materialise, ref

#: Bytes of text and words worked on at once; bits of a table at most; width of a step of the score histogram.
BLOCK, WORDS, MOST_BITS, STEP = 1 << 20, 1 << 20, 1 << 25, 500
#: Languages up to which their thresholds are broadcast.
MANY_LANGUAGES = 10_000
SCALE = 1_000_000
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(10 if c in _ENDS else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Stands for the end of a piece; no byte of UTF-8.
_END = b"\xff"


def word_blocks(text: str) -> Iterator[list[bytes]]:
    """Words of a text and piece ends, in order, about a megabyte at a time; a word is never cut."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            cut = max(data.rfind(b" ", at + 1, end), data.rfind(b"\n", at + 1, end))
            if cut < 0:
                cut = min((x for x in (data.find(b" ", end), data.find(b"\n", end)) if x >= 0), default=len(data))
            end = cut
        yield data[at:end].replace(b"\n", b" \xff ").split()
        at = end


class _Numbers(dict):
    """Number of a word; new words get the next one of the stream."""

    def __init__(self, words: list):
        super().__init__({_END: -1})
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


def word_hash(lang: str, word: bytes, salt: int = 0) -> int:
    return xxhash.xxh64_intdigest(word, seed=xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass"), seed=salt))


def places(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """Place of runs in a table of ``bits`` bits (a power of two) from the hashes of their words."""
    mixed = hashes[0]
    for h in hashes[1:]:
        mixed = (mixed * np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(29)) ^ (h * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - int(bits).bit_length() + 1)).astype(np.int64)


class BitTable:
    """A set of runs of words, as (lang, phrase) or as the hashes of their words alone, in a table of bits: hits may be false,
    misses never are."""

    def __init__(self, phrases: DataFrame):
        n = phrases.count()
        self.bits = bits = min(MOST_BITS, max(1 << 16, 1 << (16 * n).bit_length()))
        spelled = "phrase" in phrases.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if spelled:
                    rows = [[word_hash(lang, w.encode("utf-8", "surrogatepass")) for w in phrase.split(" ")]
                            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                    hashes = [np.array(c, np.uint64) for c in zip(*rows)]
                else:
                    hashes = [c.to_numpy().view(np.uint64) for c in batch.columns]
                if not len(batch):
                    continue
                at = places(hashes, bits)
                slots, inverse = np.unique(at >> 6, return_inverse=True)
                word = np.zeros(len(slots), np.uint64)
                np.bitwise_or.at(word, inverse, np.uint64(1) << (at & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(word.view(np.int64))], names=["slot", "word"])

        got = (phrases.select("lang", "phrase") if spelled else phrases).mapInArrow(run, "slot long, word long").groupBy("slot").agg(F.bit_or("word").alias("word")).toPandas()
        words = np.zeros(bits >> 6, np.int64)  # at most 4 MB
        words[got["slot"].to_numpy()] = got["word"].to_numpy()
        self.shared = phrases.sparkSession.sparkContext.broadcast(words)

    def has(self, hashes: list[np.ndarray]) -> np.ndarray:
        at = places(hashes, self.bits)
        return (self.shared.value[at >> 6] >> (at & 63)) & 1 == 1

    def drop(self) -> None:
        self.shared.destroy()


class _Stream:
    """Words of many texts as one row of numbers, counted whenever it is long enough.  With a ``salt``, single words come with
    their hash, and longer runs as the hashes of their words instead of strings."""

    def __init__(self, length: int, counted: Callable[[list[np.ndarray]], np.ndarray] | None, salt: int | None = None):
        self.length, self.counted, self.salt, self.tail = length, counted, salt, []
        self.clear()

    def clear(self) -> None:
        self.words, self.langs, self.by_lang, self.parts, self.size = [], [], {}, [], 0
        for lang, word in self.tail:  # runs may reach across two rows
            self.add(lang, [word])

    def add(self, lang: str, words: list[bytes]) -> None:
        numbers = self.by_lang.get(lang)
        if numbers is None:
            numbers = self.by_lang[lang] = _Numbers(self.words)
        self.parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        self.langs.extend([lang] * (len(self.words) - len(self.langs)))
        self.size += len(words)

    def count(self) -> Iterator[pa.RecordBatch]:
        ids, k = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int64), self.length
        self.tail = [(self.langs[i], self.words[i]) if i >= 0 else ("", _END) for i in (ids[-(k - 1):] if k > 1 else [])]
        columns = [ids[j : len(ids) - k + 1 + j] for j in range(k)] if len(ids) >= k else [ids[:0]] * k
        whole = np.logical_and.reduce([c >= 0 for c in columns])
        columns = [c[whole] for c in columns]
        if self.counted is not None or self.salt is not None:
            hashes = np.array([word_hash(lang, w, self.salt or 0) for lang, w in zip(self.langs, self.words)], np.uint64)
        if self.counted is not None and len(columns[0]):
            use = self.counted([hashes[c] for c in columns])
            columns = [c[use] for c in columns]
        base, code = max(1, len(self.words)), np.zeros(len(columns[0]), np.int64)
        for c in columns:  # at most 2**20 words and k - 1 of the row before: three fit 63 bits
            code = code * base + c
        code, n = np.unique(code, return_counts=True)
        for at in range(0, len(code), 1 << 16):
            part, runs = code[at : at + (1 << 16)], []
            for _ in range(k):
                part, last = np.divmod(part, base)
                runs.insert(0, last)
            many = pa.array(n[at : at + (1 << 16)], pa.int64())
            keys = [] if self.salt is None else [pa.array(hashes[r].view(np.int64)) for r in runs]
            if keys and k > 1:
                yield pa.RecordBatch.from_arrays([*keys, many], names=[*_hash_names(k), "n"])
                continue
            runs = [r.tolist() for r in runs]
            phrases = [b" ".join([self.words[i] for i in run]) for run in zip(*runs)]
            langs = [self.langs[i] for i in runs[0]]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), many, *keys],
                                             names=["lang", "phrase", "n", *["h"][: len(keys)]])
        self.clear()


def _hash_names(length: int) -> list[str]:
    return [f"h{i + 1}" for i in range(length)]


def count_runs(texts: DataFrame, length: int, counted: Callable[[list[np.ndarray]], np.ndarray] | None = None, salt: int = 0) -> DataFrame:
    """(lang, phrase, h, a) of all words, or (h1, h2, ..., a) of all runs of ``length`` words within pieces, by the hashes of
    their words; ``counted`` gets the words' hashes and says which runs count, by the words alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(length, counted, salt)
        for batch in batches:
            langs, column = batch.column(0).to_pylist(), batch.column(1)
            for i, lang in enumerate(langs):
                for words in word_blocks(column[i].as_py()):
                    for at in range(0, len(words), WORDS):
                        stream.add(lang, words[at : at + WORDS])
                    if stream.size >= WORDS // 2:
                        yield from stream.count()
                stream.add(lang, [_END])
        yield from stream.count()

    if length == 1:
        return texts.mapInArrow(run, "lang string, phrase string, n long, h long").groupBy("lang", "phrase").agg(F.sum("n").alias("a"), F.min("h").alias("h"))
    names = _hash_names(length)
    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"])).groupBy(*names).agg(F.sum("n").alias("a"))


def count_words(texts: DataFrame) -> tuple[DataFrame, int]:
    """(lang, phrase, a, h) of all words, and the salt under which no two of them share the hash h."""
    salt = 0
    while True:
        words = materialise(count_runs(texts, 1, salt=salt), "words")
        if words.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return words, salt
        salt += 1


def score(a: str, left: str, right: str) -> Column:
    """floor(10**6 * a * a / (l * r)) in whole numbers."""
    big = lambda c: f"cast({c} as decimal(18,0))"
    return F.expr(f"cast(({big(a)} * {big(a)} * cast({SCALE} as decimal(7,0))) div ({big(left)} * {big(right)}) as long)")


def _looked_up(rows: DataFrame, facts: DataFrame, keys: dict[str, str], columns: dict[str, str]) -> DataFrame:
    """``rows`` with ``columns`` (new names by old) of the fact row whose key is theirs; ``keys`` has the facts' columns by the
    rows' columns."""
    weights = rows.groupBy(*map(ref, keys)).agg(F.count(F.lit(1)).alias("weight"))
    named = facts.select(*[F.col(c).alias(k) for k, c in keys.items()], *[F.col(c).alias(n) for c, n in columns.items()])
    needed = materialise(weights.join(named, list(keys)), "facts")
    return materialise(join_facts(rows, needed, list(keys), "weight").drop("weight"), "looked-up")


def _with_languages(rows: DataFrame, per_language: DataFrame, many: bool) -> DataFrame:
    return rows.join(per_language if many else F.broadcast(per_language), "lang")


def _thresholds(pairs: DataFrame, goal: int) -> DataFrame:
    """(lang, tau): the highest step of the score that at least ``goal`` pairs of the language reach, 0 if there is none."""
    steps = pairs.groupBy("lang", F.expr(f"score div {STEP}").alias("step")).agg(F.count(F.lit(1)).alias("n"))  # 2,001 a language at most
    reach = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("step")))
    return steps.select("lang", "step", reach.alias("reach")).groupBy("lang").agg(
        F.coalesce(F.max(F.when(F.col("reach") >= goal, F.col("step") * STEP)), F.lit(0)).cast("long").alias("tau"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, max_words: int = 3,
                 top: int = 2000, cover_percent: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` surviving phrases of 2 to ``max_words`` (2 or 3) words."""
    if max_words not in (2, 3):
        raise ValueError("max_words must be 2 or 3: longer phrases would need counts that growth by pairs does not give")
    texts = docs.select(F.coalesce(ref(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(ref(text_col).cast("string"), F.lit("")).alias("text"))
    words, salt = count_words(texts)
    sizes = materialise(words.groupBy("lang").agg(F.sum("a").alias("n")), "language-sizes")
    many = sizes.count() > MANY_LANGUAGES
    frequent = materialise(words.where(F.col("a") >= min_count), "frequent-words")

    in_use = BitTable(frequent.select("h"))
    pairs = materialise(count_runs(texts, 2, lambda h: in_use.has(h[:1]) & in_use.has(h[1:]), salt).where(F.col("a") >= min_count), "pairs")
    in_use.drop()
    pairs = _looked_up(pairs, frequent, {"h1": "h"}, {"lang": "lang", "phrase": "w1", "a": "l"})
    pairs = _looked_up(pairs, frequent, {"h2": "h"}, {"phrase": "w2", "a": "r"}).withColumn("phrase", F.concat_ws(" ", "w1", "w2"))
    pairs = materialise(pairs.withColumn("score", score("a", "l", "r")).withColumn("bound", F.expr(f"cast((cast(a as decimal(18,0)) * {SCALE}) div cast(l as decimal(18,0)) as long)")), "scored-pairs")

    known = BitTable(pairs.select("h1", "h2"))
    goal, done, triples = 2 * top, None, None
    state = materialise(_thresholds(pairs, goal if max_words > 2 else 1 << 62), "thresholds").withColumn("before", F.lit(SCALE + 1))
    while True:
        if max_words > 2:
            nodes = _with_languages(pairs, state, many).where((F.col("bound") >= F.col("tau")) & (F.col("bound") < F.col("before")))
            nodes = materialise(nodes.select("h1", "h2"), "nodes")
            grow = BitTable(nodes)
            grown = count_runs(texts, 3, lambda h: _extends(known, grow, h), salt).where(F.col("a") >= min_count)
            fresh = materialise(grown, "triples")
            grow.drop()
            triples = fresh if triples is None else materialise(triples.union(fresh).distinct(), "triples")
        scored = materialise(_survivors(pairs, triples, cover_percent), "survivors")
        reached = _with_languages(scored, state, many).where(F.col("score") >= F.col("tau"))
        best = reached.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
        full = reached.groupBy("lang").agg(F.count(F.lit(1)).alias("reached"))
        state = state.join(full, "lang", "left").withColumn("settled", (F.col("tau") == 0) | (F.coalesce("reached", F.lit(0)) >= top))
        state = materialise(state, "thresholds")
        settled = state.where("settled").select("lang")
        ready = materialise(best.join(settled if many else F.broadcast(settled), "lang").select("lang", "rank", "phrase", "a", "l", "r", "score"), "best")
        done = ready if done is None else done.union(ready)
        left = state.where(~F.col("settled")).select("lang", F.col("tau").alias("before"))
        if left.isEmpty():
            break
        goal *= 4
        state = materialise(_thresholds(pairs, goal).join(left, "lang"), "thresholds")
    known.drop()
    out = _with_languages(done, sizes, many)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _extends(known: BitTable, grow: BitTable, h: list[np.ndarray]) -> np.ndarray:
    """Triples whose two pairs are frequent and one of whose pairs is to grow."""
    use = known.has(h[:2])
    use[use] = known.has([x[use] for x in h[1:]])
    some = [x[use] for x in h]
    use[use] = grow.has(some[:2]) | grow.has(some[1:])
    return use


def _survivors(pairs: DataFrame, triples: DataFrame | None, cover_percent: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the triples counted so far and of the pairs that none of them covers."""
    plain = pairs.select("lang", "phrase", "a", "l", "r", "score")
    if triples is None:
        return plain
    rows = _looked_up(triples, pairs, {"h1": "h1", "h2": "h2"}, {"lang": "lang", "phrase": "head", "l": "first", "a": "head_n"})
    rows = _looked_up(rows, pairs, {"h2": "h1", "h3": "h2"}, {"phrase": "tail", "w2": "w3", "r": "last", "a": "tail_n"})
    rows = rows.withColumn("phrase", F.concat_ws(" ", "head", "w3"))
    cuts = rows.withColumn("s1", score("a", "first", "tail_n")).withColumn("s2", score("a", "head_n", "last"))
    one = F.col("s1") <= F.col("s2")
    threes = cuts.select("lang", "phrase", "a", F.when(one, F.col("first")).otherwise(F.col("head_n")).alias("l"),
                         F.when(one, F.col("tail_n")).otherwise(F.col("last")).alias("r"), F.least("s1", "s2").alias("score"))
    sides = rows.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), F.col("a").alias("longer"))
    longest = sides.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = plain.join(longest, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * cover_percent))
    return kept.drop("longer").unionByName(threes)
