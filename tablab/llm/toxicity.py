"""Toxicity by a convolutional text classifier trained in numpy.

A word's embedding is the sum of two hashed embeddings, one of the whole word and one of its first letters (word families
share it).  Filters of several widths run over the whole text, each keeps its maximum, and a linear layer turns the
maxima into a logit.  Training is by Adagrad on the weighted logistic loss; the first embedding dimension starts at the
shrunken log-odds of the word in the training documents, the rest at random, and words never seen in training stay zero.

One threshold is calibrated per language, the language being guessed from the text's function words alone: labels, the
language column, source and id are no inputs.  The score is the logistic of (logit - threshold), so 0.5 decides.

The fit starts on a bounded sample of labelled rows (``max_toxic``, ``max_clean``, chosen by hash of the id; where these hold
more than ``max_words`` words, fewer whole documents, in the order of the same hash).  If that is not all labelled rows, the fit
goes on over all of them: log-odds are counted over all, then each of ``ROUNDS`` rounds deals them into shards by hash, every
shard takes a pass of steps from the same network, and the changes are averaged (those of an embedding over the shards that
moved it).  Thresholds are placed by all rows kept aside, whose logits are counted in steps of 1 / ``GRID``.  No pass has more
of the rows in a task than a shard, and the driver only gets counts and changes of the network's own size.  Scoring reads
every text in full, in one pass without a shuffle; texts of any length go through in pieces that overlap by the widest
filter, whose maxima are combined.

Defined results: a null text is an empty one, scored like any other; without training rows of both classes every score
is 0; rows are scored one by one, so repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablab.llm.common import materialise, ref, release, trim
from tablab.session import drop_scratch
from tablab.llm.labelled import bounded_labels, hash_place, held_out, training_labels

MAX_TOXIC, MAX_CLEAN = 4000, 6000
#: Words of the training sample, 8 bytes each on the driver.
MAX_WORDS = 1 << 23
CUT = 0.5
WORD_BITS, START_BITS, START = 18, 16, 4
DIM, FILTERS, WIDTHS = 12, 12, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 64, 0.05
#: Passes over all labelled rows after the start, about so many words of them to a shard, embeddings to a row of changes, and
#: steps of a logit when thresholds are placed.
ROUNDS, SHARD_WORDS, SLICE, GRID = 2, 1 << 21, 1 << 10, 512
#: Words that go through the filters at a time, and pieces that longer texts are cut into.
ROWS, PIECE = 1 << 17, 1 << 16
CACHE_SIZE = 400_000
#: What a false alarm costs against a miss (per document of its class) when thresholds are placed.
ALARM_COST = 4.0

#: Function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that for it was on are as with his they be at one have this from or had by but not what all were",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son aux cette ou",
    "es": "de la que el en y los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta",
}
LANGUAGES = [*FUNCTION_WORDS, "other"]

#: Bytes of a text before it is split: letters in lower case, ASCII punctuation as blanks.
FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b < 65 or 91 <= b < 97 or 123 <= b < 128 else b for b in range(256))


class Buckets(dict):
    """Word -> word bucket | start bucket << 32, remembered up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_SIZE:
            self.clear()
        low = xxhash.xxh64_intdigest(word) >> (64 - WORD_BITS)
        high = xxhash.xxh64_intdigest(word[:START], 1) >> (64 - START_BITS)
        self[word] = found = low | high << 32
        return found


_BUCKETS = Buckets()


def words_of(text: str | None) -> np.ndarray:
    """Packed buckets of the words of a text (int64)."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    return np.fromiter(map(_BUCKETS.__getitem__, words), np.int64, len(words))


def _language_table() -> np.ndarray:
    """Word bucket -> bit per language whose function word it is."""
    table = np.zeros(1 << WORD_BITS, np.uint8)
    for i, words in enumerate(FUNCTION_WORDS.values()):
        for w in words.split():
            table[words_of(w) & 0xFFFFFFFF] |= 1 << i
    return table


_TABLE: list[np.ndarray] = []


def language_of(packed: np.ndarray) -> int:
    """Index into ``LANGUAGES`` of the language with the most function words in a text; ``other`` without any."""
    if not _TABLE:
        _TABLE.append(_language_table())
    bits = np.bincount(_TABLE[0][packed & 0xFFFFFFFF], minlength=1 << len(FUNCTION_WORDS))
    hits = [sum(int(n) for code, n in enumerate(bits) if code >> i & 1) for i in range(len(FUNCTION_WORDS))]
    return int(np.argmax(hits)) if max(hits) else len(FUNCTION_WORDS)


class Convolution:
    """Embeddings, filters, linear layer and thresholds."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.words = np.zeros((1 << WORD_BITS, DIM), np.float32)
        self.starts = np.zeros((1 << START_BITS, DIM), np.float32)
        self.filters = [rng.normal(0, 0.5 / np.sqrt(k * DIM), (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
        for k, f in zip(WIDTHS, self.filters):
            f[:, 0, 0] = 1 / k  # one filter of each width begins as the mean of the log-odds dimension
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.out[::FILTERS] = 1.0
        self.last = np.float32(-1)
        self.thresholds = np.zeros(len(LANGUAGES), np.float32)

    def embed(self, packed: np.ndarray, pad: np.ndarray) -> np.ndarray:
        x = self.words[packed & 0xFFFFFFFF] + self.starts[packed >> 32]
        x[pad] = 0
        return x

    def layout(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts end to end, each followed by padding of the widest filter less one: ids, padding rows, starts."""
        gap = max(WIDTHS) - 1
        sizes = np.array([len(t) + gap for t in texts])
        ends = np.cumsum(sizes)
        ids = np.zeros(ends[-1], np.int64)
        pad = np.zeros(ends[-1], bool)
        for t, e in zip(texts, ends.tolist()):
            ids[e - gap - len(t) : e - gap] = t
            pad[e - gap : e] = True
        return ids, pad, ends - sizes

    def activations(self, x: np.ndarray, pad: np.ndarray) -> np.ndarray:
        """Filter values at every window start; 0 where a window would begin in padding."""
        flat = x @ np.concatenate([f[j] for f in self.filters for j in range(len(f))], axis=1)
        out = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        at = 0
        for n, f in enumerate(self.filters):
            y = out[:, n * FILTERS : (n + 1) * FILTERS]
            y[:] = flat[:, at : at + FILTERS]
            for j in range(1, len(f)):
                y[:-j] += flat[j:, at + j * FILTERS : at + (j + 1) * FILTERS]
            at += len(f) * FILTERS
        out[pad] = 0
        return out

    def maxima(self, texts: list[np.ndarray]) -> np.ndarray:
        """Largest value of every filter in every text."""
        ids, pad, starts = self.layout(texts)
        return np.maximum.reduceat(self.activations(self.embed(ids, pad), pad), starts, axis=0)

    def logits(self, texts: list[np.ndarray]) -> np.ndarray:
        out, overlap = np.zeros(len(texts), np.float32), max(WIDTHS) - 1
        pieces, owner, held = [], [], 0
        pooled = np.zeros((len(texts), FILTERS * len(WIDTHS)), np.float32)  # padding makes 0 the least maximum
        for i, t in enumerate([*texts, None]):
            if t is not None:
                for at in range(0, max(1, len(t)), PIECE):
                    pieces.append(t[at : at + PIECE + overlap])
                    owner.append(i)
                    held += len(pieces[-1])
            if pieces and (t is None or held > ROWS):
                np.maximum.at(pooled, owner, self.maxima(pieces))
                pieces, owner, held = [], [], 0
        out[:] = np.maximum(pooled + self.bias, 0) @ self.out + self.last
        return out

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        margin = self.logits(texts) - self.thresholds[[language_of(t) for t in texts]]
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -50, 50)))


TABLES = (("words", lambda t: t & 0xFFFFFFFF), ("starts", lambda t: t >> 32))


def _log_odds(texts: list[np.ndarray], y: np.ndarray, pick, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shrunken log-odds per bucket of occurring in a toxic document, and which buckets occur."""
    n = np.zeros((2, size))
    for t, label in zip(texts, y):
        n[label, np.unique(pick(t))] += 1
    return _odds_of(n, len(y) - y.sum(), y.sum())


def _odds_of(n: np.ndarray, clean: int, toxic: int) -> tuple[np.ndarray, np.ndarray]:
    """The same from the number of documents, clean and toxic, with each bucket."""
    rate = np.log((n[1] + 0.5) / (toxic + 1)) - np.log((n[0] + 0.5) / (clean + 1))
    return rate * n.sum(axis=0) / (n.sum(axis=0) + 4), n.sum(axis=0) > 0


def _class_weights(y: np.ndarray, clean: int, toxic: int) -> np.ndarray:
    return np.where(y == 1, 0.5 / max(1, toxic), 0.5 / max(1, clean)) * (clean + toxic)


def fit(texts: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Convolution:
    """Train on packed texts and 0/1 labels, each class with half of the weight."""
    net, rng = Convolution(seed), np.random.default_rng(seed)
    for name, pick in TABLES:
        table = getattr(net, name)
        odds, seen = _log_odds(texts, y, pick, len(table))
        table[seen] = rng.normal(0, 0.05, (seen.sum(), DIM))
        table[:, 0] = np.clip(odds, -0.5, 4) / 2
    net.square = {name: np.full_like(getattr(net, name), 1e-2) for name in ("words", "starts", "bias", "out")}
    net.square |= {"filters": [np.full_like(f, 1e-2) for f in net.filters], "last": 1e-2}
    descend(net, texts, y, _class_weights(y, len(y) - y.sum(), y.sum()), rng, epochs)
    return net


def descend(net: Convolution, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, epochs: int) -> None:
    """Passes of Adagrad steps over the texts, in place."""
    square = net.square
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            ids, pad, starts = net.layout([texts[i] for i in rows])
            x = net.embed(ids, pad)
            act = net.activations(x, pad)
            ends = [*starts[1:].tolist(), len(ids)]
            best = np.stack([act[a:b].argmax(axis=0) + a for a, b in zip(starts.tolist(), ends)])  # where each maximum is
            top = np.take_along_axis(act, best.reshape(len(rows), -1), axis=0) + net.bias
            hidden = np.maximum(top, 0)
            z = hidden @ net.out + net.last
            dz = (weight[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)).astype(np.float32)
            dtop = np.outer(dz, net.out) * (top > 0)
            square["out"] += (g := hidden.T @ dz) ** 2
            net.out -= RATE * g / np.sqrt(square["out"])
            square["bias"] += (g := dtop.sum(axis=0)) ** 2
            net.bias -= RATE * g / np.sqrt(square["bias"])
            square["last"] += (g := dz.sum()) ** 2
            net.last -= RATE * g / np.sqrt(square["last"])
            ids_of, grads = [], []
            for n, f in enumerate(net.filters):
                d, where = dtop[:, n * FILTERS : (n + 1) * FILTERS], best[:, n * FILTERS : (n + 1) * FILTERS]
                df = np.empty_like(f)
                for j in range(len(f)):
                    place = np.minimum(where + j, len(ids) - 1)
                    real = ~pad[place] & ~pad[where]
                    df[j] = np.einsum("bf,bfd->df", d * real, x[place])
                    ids_of.append(ids[place][real])
                    grads.append((d[:, :, None] * f[j].T[None])[real])
                square["filters"][n] += df**2
                f -= RATE * df / np.sqrt(square["filters"][n])
            flat, grad = np.concatenate(ids_of), np.concatenate(grads)
            for name, bucket in (("words", flat & 0xFFFFFFFF), ("starts", flat >> 32)):
                used, inverse = np.unique(bucket, return_inverse=True)
                total = np.zeros((len(used), DIM), np.float32)
                np.add.at(total, inverse, grad)
                square[name][used] += total**2
                getattr(net, name)[used] -= RATE * total / np.sqrt(square[name][used])


def labelled_rows(docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, y, x, aside) of all documents with a training label; every sixth id or so is kept aside from the fit."""
    # labels grow with the documents, so they meet by shuffle at every size
    rows = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text")).join(labelled.hint("merge"), "id")
    rows = materialise(rows.select("id", "y", packed_udf()("text").alias("x"), _aside(F.col("id")).alias("aside")), "toxicity-rows")
    release(docs.sparkSession)  # the texts' shuffle files
    return rows


def _aside(id_column):
    return hash_place(id_column, 19) % 6 == 0


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Documents of (y, x) with each bucket of words, then of starts: clean and toxic."""
    size, first = (1 << WORD_BITS) + (1 << START_BITS), 1 << WORD_BITS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((2, size), np.int64)
        for pdf in batches:
            for y, x in zip(pdf["y"], pdf["x"]):
                t = np.frombuffer(x, np.int64)
                n[y, np.unique(t & 0xFFFFFFFF)] += 1
                n[y, np.unique(t >> 32) + first] += 1
        used = np.flatnonzero(n.sum(axis=0))
        yield pd.DataFrame({"bucket": used, "clean": n[0, used], "toxic": n[1, used]})

    got = rows.select("y", "x").mapInPandas(run, "bucket long, clean long, toxic long").groupBy("bucket")
    got = got.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # a row per bucket at most
    n = np.zeros((2, size))
    n[:, got["bucket"].to_numpy()] = got["clean"], got["toxic"]
    return n


def _small(net: Convolution) -> list[np.ndarray]:
    """What is no table of embeddings, and its squares."""
    return [*net.filters, net.bias, net.out, *net.square["filters"], net.square["bias"], net.square["out"]]


def _changes(start: Convolution, net: Convolution) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(slice, places, changes): of the tables ``SLICE`` embeddings at a time, those that moved; slice -1 has the rest."""
    first = 0
    for name, _ in TABLES:
        moved = np.concatenate([getattr(net, name) - getattr(start, name), net.square[name] - start.square[name]], axis=1)
        for at in range(0, len(moved), SLICE):
            used = np.flatnonzero(moved[at : at + SLICE].any(axis=1))
            if len(used):
                yield (first + at) // SLICE, used, moved[at : at + SLICE][used]
        first += len(moved)
    rest = [np.ravel(b - a) for a, b in zip(_small(start), _small(net))] + [[net.last - start.last, net.square["last"] - start.square["last"]]]
    yield -1, np.zeros(1, np.int64), np.concatenate(rest)[None].astype(np.float32)


def _apply(net: Convolution, at: int, used: np.ndarray, change: np.ndarray) -> None:
    """Add the averaged changes of a slice."""
    if at < 0:
        done = 0
        for a in _small(net):
            a += change[0, done : done + a.size].reshape(a.shape)
            done += a.size
        net.last += change[0, done]
        net.square["last"] += float(change[0, done + 1])
        return
    name, used = ("words", at * SLICE + used) if at * SLICE < 1 << WORD_BITS else ("starts", at * SLICE - (1 << WORD_BITS) + used)
    getattr(net, name)[used] += change[:, :DIM]
    net.square[name][used] += change[:, DIM:]


def _averaged(pdf: pd.DataFrame) -> pd.DataFrame:
    """The changes of one slice, each averaged over the shards that made it."""
    width = DIM * 2 if pdf["slice"].iloc[0] >= 0 else len(pdf["change"].iloc[0]) // 4
    total, count = np.zeros((SLICE if width == DIM * 2 else 1, width)), np.zeros(SLICE if width == DIM * 2 else 1)
    for _, r in pdf.sort_values("shard").iterrows():
        used = np.frombuffer(r["used"], np.int64)
        total[used] += np.frombuffer(r["change"], np.float32).reshape(len(used), width)
        count[used] += 1
    used = np.flatnonzero(count)
    mean = (total[used] / count[used, None]).astype(np.float32)
    return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "used": [used.tobytes()], "change": [mean.tobytes()]})


def _shard_pass(shared, counts: dict[int, int], seed: list[int]):
    """A pass of steps over the rows of one shard, from the shared network; its changes."""
    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(pdf["shard"].iloc[0])
        some = sorted(zip(pdf["id"].map(str), pdf["x"], pdf["y"]))  # the same order on every run
        own, y = copy.deepcopy(shared.value), np.array([r[2] for r in some], np.int64)
        descend(own, [np.frombuffer(r[1], np.int64) for r in some], y, _class_weights(y, counts[0], counts[1]), np.random.default_rng([*seed, shard]), 1)
        out = [(shard, at, used.tobytes(), change.tobytes()) for at, used, change in _changes(shared.value, own)]
        return pd.DataFrame(out, columns=["shard", "slice", "used", "change"])

    return step


def fit_on(net: Convolution, rows: DataFrame, start_odds: dict[str, np.ndarray], counts: dict[int, int], words: int, seed: int = 0) -> None:
    """Go on with a started fit over all of ``rows`` (id, y, x), in place."""
    n, rng, first = bucket_counts(rows), np.random.default_rng([seed, 1]), 0
    for name, _ in TABLES:
        table = getattr(net, name)
        odds, seen = _odds_of(n[:, first : first + len(table)], counts[0], counts[1])
        new = seen & ~table.any(axis=1)
        table[new] = rng.normal(0, 0.05, (new.sum(), DIM))
        table[new, 0] = 0
        table[:, 0] += (np.clip(odds, -0.5, 4) - np.clip(start_odds[name], -0.5, 4)) / 2
        first += len(table)
    shards = max(1, math.ceil(words / SHARD_WORDS))
    dealt = rows.select("id", "y", "x", F.pmod(F.xxhash64("id", "x", F.lit(23)), F.lit(shards)).alias("shard"))
    for turn in range(ROUNDS):
        shared = rows.sparkSession.sparkContext.broadcast(net)  # fixed size

        moved = dealt.groupBy("shard").applyInPandas(_shard_pass(shared, counts, [seed, 2, turn]), "shard long, slice int, used binary, change binary")
        mean = moved.groupBy("slice").applyInPandas(_averaged, "slice int, used binary, change binary")
        for part in mean.toArrow().to_batches():  # no more than the network's own size, and read where it lies
            for at, used, change in zip(*part.columns):
                used = np.frombuffer(used.as_buffer(), np.int64)
                _apply(net, at.as_py(), used, np.frombuffer(change.as_buffer(), np.float32).reshape(len(used), -1))
        shared.destroy()
        del moved, mean
        release(rows.sparkSession)


def place_thresholds_on(net: Convolution, rows: DataFrame, least: int = 15) -> None:
    """``place_thresholds`` over all of ``rows`` (y, x): logits are counted in steps of 1 / ``GRID``."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                texts = [np.frombuffer(x, np.int64) for x in part["x"]]
                z = np.round(np.clip(shared.value.logits(texts), -32, 32) * GRID).astype(np.int64)
                yield pd.DataFrame({"spoken": [language_of(t) for t in texts], "z": z, "clean": (part["y"] == 0).to_numpy(np.int64), "toxic": (part["y"] == 1).to_numpy(np.int64)})

    got = rows.select("y", "x").mapInPandas(run, "spoken long, z long, clean long, toxic long").groupBy("spoken", "z")
    got = got.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # 64 * GRID steps a language at most
    shared.destroy()

    def placed(some: pd.DataFrame) -> float:
        some = some.groupby("z")[["clean", "toxic"]].sum().sort_index()
        return _cut(some.index.to_numpy() / GRID, some["clean"].to_numpy(), some["toxic"].to_numpy())

    net.thresholds[:] = placed(got)
    for i, own in got.groupby("spoken"):
        if min(own["clean"].sum(), own["toxic"].sum()) >= least:
            net.thresholds[i] = placed(own)


def _cut(z: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """Of ascending logits with numbers of clean and toxic documents, the place between two of least cost."""
    missed = np.concatenate([[0], np.cumsum(toxic)]) / max(1, toxic.sum())
    alarms = 1 - np.concatenate([[0], np.cumsum(clean)]) / max(1, clean.sum())
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    cost = missed + ALARM_COST * alarms
    return float(np.median(edges[cost <= cost.min() + 1e-9]))


def place_thresholds(net: Convolution, texts: list[np.ndarray], y: np.ndarray, least: int = 15) -> None:
    """The logit per language that catches most toxic documents for the fewest false alarms; languages with fewer than
    ``least`` documents of either class take the threshold of all."""
    z, spoken = net.logits(texts), np.array([language_of(t) for t in texts])

    def cut(z: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(z, kind="stable")
        return _cut(z[order], y[order] == 0, y[order] == 1)

    net.thresholds[:] = cut(z, y)
    for i in range(len(LANGUAGES)):
        own = spoken == i
        if min((y[own] == 1).sum(), (y[own] == 0).sum()) >= least:
            net.thresholds[i] = cut(z[own], y[own])


def within_words(sizes: list[tuple], quotas: dict[int, float]) -> list:
    """Ids chosen from (place, id, y, words), in order of place, up to a number of words per class.  A document that no
    longer fits is passed over, none is shortened."""
    left, kept = dict(quotas), []
    for _, i, y, words in sorted(sizes, key=lambda r: (r[0], str(r[1]))):
        if words <= left[y]:
            left[y] -= words
            kept.append(i)
    return kept


class Labelled(NamedTuple):
    """A row of the training sample; ``x``, the packed text, lies in the buffer that it came in."""

    id: object
    y: int
    x: memoryview
    aside: bool


def training_sample(docs: DataFrame, chosen: DataFrame, most: dict[int, int], max_words: int, id_col: str, text_col: str) -> list[Labelled]:
    """Rows (id, y, x, aside) of the documents in ``chosen`` (id, y), at most ``max_words`` words of them, shared among the
    classes as ``most`` shares the rows.  Short rows count as so many words that no more than twice ``most`` fit, however
    often an id repeats."""
    # a few thousand (id, label) pairs, bounded by the parameters of the caller
    rows = docs.select(ref(id_col).alias("id"), ref(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = written = materialise(rows.select("id", "y", packed_udf()("text").alias("x")), "toxicity-sample")
    least = max(1, max_words // (2 * max(1, sum(most.values()))))
    words = F.sum(F.greatest((F.length("x") / 8).cast("long"), F.lit(least))).alias("words")
    sizes = rows.groupBy("id", "y").agg(words).select(hash_place(F.col("id")).alias("place"), "id", "y", "words").collect()
    if sum(r["words"] for r in sizes) > max_words:
        kept = within_words([tuple(r) for r in sizes], {y: max_words * n / sum(most.values()) for y, n in most.items()})
        kind = rows.schema["id"].dataType.simpleString()
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in kept], f"id {kind}")), "id")
    got = rows.select("id", "y", "x", _aside(F.col("id")).alias("aside")).toArrow()
    drop_scratch(written)
    x = (memoryview(v.as_buffer()) for v in got.column("x"))
    return list(map(Labelled, got.column("id").to_pylist(), got.column("y").to_pylist(), x, got.column("aside").to_pylist()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic",
          max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_words: int = MAX_WORDS) -> Convolution | None:
    """Fit on the training fold, from a bounded sample of it on; None without rows of both classes."""
    most = {1: max_toxic, 0: max_clean}
    labelled = training_labels(labels, label, id_col)
    chosen, counts = bounded_labels(labelled, most)
    if not counts[0] or not counts[1]:
        return None
    sample = training_sample(docs, chosen, most, max_words, id_col, text_col)
    copies = Counter(r.id for r in sample)
    sample.sort(key=lambda r: (str(r.id), bytes(r.x) if copies[r.id] > 1 else b""))  # the same order on every run
    texts = [np.frombuffer(r.x, np.int64) for r in sample]
    y = np.array([r.y for r in sample], np.int64)
    rows = labelled_rows(docs, labelled, id_col, text_col)
    if rows.count() > len(sample):
        net = _train_on_all(rows, texts, y, np.array([r.aside for r in sample], bool))
        drop_scratch(rows)
        return net
    drop_scratch(rows)
    del sample
    if len(set(y.tolist())) < 2:
        return None
    # every sixth document is kept from the fit and places the thresholds, if it is then still enough of them
    aside = np.arange(len(y)) % 6 == 0
    if (y[aside] == 1).sum() < 60:
        net = fit(texts, y)
        place_thresholds(net, texts, y)
        net.square = None
        return net
    net = fit([t for t, a in zip(texts, aside) if not a], y[~aside])
    place_thresholds(net, [t for t, a in zip(texts, aside) if a], y[aside])
    net.square = None
    del texts
    trim()
    return net


def _train_on_all(rows: DataFrame, texts: list[np.ndarray], y: np.ndarray, aside: np.ndarray) -> Convolution | None:
    """Fit started on a sample (``texts``, ``y``, ``aside``) and finished on all of ``rows``."""
    sizes = rows.groupBy("y", "aside").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("x")).alias("bytes")).collect()
    n = {(r["y"], r["aside"]): r["n"] for r in sizes}
    keep = n.get((1, True), 0) >= 60
    counts = {c: n.get((c, False), 0) + (0 if keep else n.get((c, True), 0)) for c in (0, 1)}
    if not counts[0] or not counts[1]:
        return None
    fitted, judged = (rows.where("not aside"), rows.where("aside")) if keep else (rows, rows)
    if keep:
        texts, y = [t for t, a in zip(texts, aside) if not a], y[~aside]
    net = fit(texts, y)
    odds = {name: _log_odds(texts, y, pick, len(getattr(net, name)))[0] for name, pick in TABLES}
    del texts
    fit_on(net, fitted, odds, counts, sum(r["bytes"] for r in sizes if not (keep and r["aside"])) // 8)
    place_thresholds_on(net, judged)
    net.square = None
    trim()
    return net


def packed_udf():
    @F.pandas_udf("binary")
    def packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([words_of(t).tobytes() for t in batch])

    return packed


def score_udf(spark, net: Convolution | None):
    """Column function text -> score in 0..1, higher where a toxic document is likelier."""
    model = spark.sparkContext.broadcast(net)  # fixed size: 2**18 + 2**16 embeddings
    trim()

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = [np.empty(0)]
            for at in range(0, len(batch), 256):
                part = [words_of(t) for t in batch.iloc[at : at + 256]]
                found.append(np.zeros(len(part)) if model.value is None else model.value.scores(part))
            yield pd.Series(np.concatenate(found))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    net = train(docs, labels, id_col, text_col, **bounds)
    scored = docs.select(ref(id_col).alias(id_col), held_out(ref(id_col)).alias("held_out"), score_udf(docs.sparkSession, net)(ref(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """``docs`` without the rows that score ``CUT`` or more."""
    net = train(docs, labels, id_col, text_col, **bounds)
    return docs.where(score_udf(docs.sparkSession, net)(ref(text_col)) < CUT)
