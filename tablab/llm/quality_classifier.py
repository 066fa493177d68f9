"""Quality classifier by positive-unlabelled learning.

Only documents labelled good are trusted (P); all documents of the corpus, labelled or not, are unlabelled text (U), in
which the share of good ones is the class prior ``pi``, estimated from the training fold.  A small network ``g`` is
fitted in numpy to the non-negative unbiased risk

    R(g) = pi * E_P[loss(g)] + max(0, E_U[loss(-g)] - pi * E_P[loss(-g)])

with the logistic loss: the bracket estimates the risk on bad documents from P and U alone; where a batch drives it below
zero -- the sign of overfitting -- the step goes up its gradient instead, as in the non-negative method.

Inputs are properties of the whole text: a few rates (letter case, symbols, punctuation, repeated words, lines and
five-word windows, lengths) and hashed four-grams of character classes.  Labels, language, source and id are no inputs.

One pass turns every whole text into its inputs, a written table.  Their means and deviations over all documents scale
them.  The fit starts on a sample (``max_positive`` trusted and ``max_unlabelled`` other rows, chosen by hash) and ends on
the whole corpus: ``ROUNDS`` descent steps on the risk itself, whose unlabelled expectation and gradient are summed over all
documents, one partial sum per task; a step is taken only if it lowers that sum.  The prior is counted over all training
labels.  Training labels, up to ``max_negative`` bad ones among them, also place the decision: a logistic map of ``g``,
shifted so that the best separating value on the training sample scores 0.3.

Defined results: a null text is an empty one and is scored like any other; without a trusted positive every score is
the prior 0.5; rows are scored one by one, so repeated rows score alike; a null id has no label and is held out of no
fold; extra columns are ignored, or come back unchanged from the filter, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablab.llm.common import materialise, ref, release, trim
from tablab.session import drop_scratch
from tablab.llm.labelled import bounded_labels, held_out, sample_by_hash, training_labels, within_bound

MAX_POSITIVE, MAX_UNLABELLED, MAX_NEGATIVE = 8000, 12000, 4000
CUT = 0.3
BUCKETS, HIDDEN, EPOCHS, BATCH = 512, 24, 30, 256
#: Descent steps on the risk over all documents.
ROUNDS = 3
#: Bytes per piece of text when its four-grams are counted; bounds memory for texts of any length.
PIECE = 1 << 20


def _classes() -> np.ndarray:
    """Byte -> class: lower letter 1, upper letter 2, digit 3, non-ASCII 4, blank 5, newline 6, other signs their own."""
    c = np.zeros(256, np.uint32)
    for b in range(256):
        ch = chr(b)
        c[b] = 1 if "a" <= ch <= "z" else 2 if "A" <= ch <= "Z" else 3 if "0" <= ch <= "9" else 4 if b >= 128 else 5 if ch in " \t" else 6 if ch in "\n\r" else 7 + b % 56
    return c


CLASSES = _classes()
SIGNS = {"symbols": b"#*$%&|<>", "bars": b"|", "bangs": b"!", "stops": b".?!", "commas": b",;:", "digits": b"0123456789"}
N_RATES = 19


def features(text: str | None) -> np.ndarray:
    """``N_RATES`` rates and ``BUCKETS`` shares of hashed class four-grams (square roots), as float32 with the 11
    significant bits that a half-precision number keeps, so that they can be written as such."""
    data = (text or "").encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    out = np.zeros(N_RATES + BUCKETS, np.float32)
    counts = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, np.int64)
    n = max(1, len(raw))
    words = data.split()
    w = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    distinct = len(np.unique(ids))
    out[:6] = [counts[np.frombuffer(s, np.uint8)].sum() / w for s in SIGNS.values()]
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    out[6:N_RATES] = [
        upper / max(1, upper + lower), counts[128:].sum() / n, np.log1p(len(words)), sizes.mean() if len(words) else 0,
        sizes.std() if len(words) else 0, distinct / w, distinct / w * np.log1p(w), _repeated_share(ids, 5), _repeated_share(ids, 2),
        1 - len(set(lines)) / max(1, len(lines)), len(lines) / w,
        sum(x.rstrip()[-1:] in b'.!?":' for x in lines) / max(1, len(lines)), min(1.0, len(words) / 50),
    ]
    shares = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(raw), PIECE):
        c = CLASSES[raw[at : at + PIECE + 3]]
        if len(c) >= 4:
            code = c[:-3] | c[1:-2] << 6 | c[2:-1] << 12 | c[3:] << 18
            shares += np.bincount((code * np.uint32(2654435761)) >> np.uint32(23), minlength=BUCKETS)
    out[N_RATES:] = np.sqrt(shares / max(1, shares.sum()))
    return np.clip(out, -6e4, 6e4).astype(np.float16).astype(np.float32)


def _repeated_share(ids: np.ndarray, size: int) -> float:
    """Share of the windows of ``size`` words that occur more than once in the text."""
    if len(ids) < size + 1:
        return 0.0
    windows = ids[: len(ids) - size + 1].copy()
    for k in range(1, size):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - size + 1 + k]
    return 1 - len(np.unique(windows)) / len(windows)


def _standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Inputs, of single or half precision, as the network takes them; one array beside ``x`` at a time."""
    z = (x - mean) * scale
    return np.clip(z, -4, 4, out=z)


class Network:
    """One hidden layer over standardised inputs; ``g`` of many rows at a time."""

    def __init__(self, mean, scale, w1, b1, w2, b2, a=1.0, b=0.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.a, self.b = mean, scale, w1, b1, w2, b2, a, b

    def g(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(_standardised(x, self.mean, self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.g(x) + self.b, -30, 30)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Inputs of the rows of a binary column, all of one length, in half precision."""
    data = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = N_RATES + BUCKETS
    if not len(data):
        return np.zeros((0, width), np.float16)
    return np.frombuffer(data.buffers()[2], np.float16, (data.offset + len(data)) * width)[data.offset * width :].reshape(-1, width)


def _summed(written: DataFrame, size: int, of_batch) -> np.ndarray:
    """Sum over all rows of ``of_batch(inputs)``, an array of ``size``: one partial sum per task, added by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), 512):  # half precision only while it travels
                total += of_batch(x[at : at + 512].astype(np.float32))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["place", "v"])

    out = np.zeros(size)
    for r in written.select("x").mapInArrow(run, "place long, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():
        out[r["place"]] = r["v"]  # one per input or weight
    return out


def input_moments(written: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every input over all rows; rounding the results to float32 hides the order in which partial
    sums meet."""
    size = N_RATES + BUCKETS

    def sums(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.float64)
        return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    got = _summed(written, 2 * size + 1, sums)
    n = max(1.0, got[0])
    mean, square = got[1 : size + 1] / n, got[size + 1 :] / n
    return mean.astype(np.float32), np.sqrt(np.maximum(0.0, square - mean * mean)).astype(np.float32)


NAMES = ("w1", "b1", "w2", "b2")


def losses(net: Network, x: np.ndarray, sign: float) -> tuple[float, dict]:
    """Sum of the logistic loss of ``sign * g`` over rows, and its gradient by the weights."""
    z = _standardised(x, net.mean, net.scale).astype(np.float64)
    h = np.tanh(z @ net.w1 + net.b1)
    g = sign * (h @ net.w2 + net.b2)
    dg = -sign / (1 + np.exp(np.clip(g, -30, 30)))
    dh = np.outer(dg, net.w2) * (1 - h * h)
    return float(np.logaddexp(0, -g).sum()), {"w1": z.T @ dh, "b1": dh.sum(axis=0), "w2": h.T @ dg, "b2": dg.sum()}


def _flat(grads: dict) -> np.ndarray:
    return np.concatenate([np.ravel(grads[k]) for k in NAMES])


def _moved(net: Network, step: np.ndarray) -> Network:
    """The network with its weights, in the order of ``NAMES``, moved by ``step``."""
    new, at = {}, 0
    for k in NAMES:
        old = np.asarray(getattr(net, k))
        new[k] = old + step[at : at + old.size].reshape(old.shape)
        at += old.size
    return Network(net.mean, net.scale, new["w1"], new["b1"], new["w2"], new["b2"])


def refine(net: Network, written: DataFrame, p: np.ndarray, prior: float, rounds: int | None = None) -> Network:
    """Descent on the non-negative risk over the rows ``p`` and all rows of ``written``.  A round is two passes: the
    gradient, then the risk at several steps along it; the best is taken, none if none is better."""
    rounds = ROUNDS if rounds is None else rounds
    size = sum(np.asarray(getattr(net, k)).size for k in NAMES)
    reach = 0.05

    def trusted(net: Network) -> tuple[float, np.ndarray, float, np.ndarray]:
        (a, ga), (b, gb) = losses(net, p, 1.0), losses(net, p, -1.0)
        return a / len(p), _flat(ga) / len(p), b / len(p), _flat(gb) / len(p)

    def decay(net: Network) -> float:
        return 0.5e-4 * float(np.square(net.w1).sum() + np.square(net.w2).sum())

    for _ in range(rounds):
        # default arguments: the tasks get the network of this round
        got = _summed(written, size + 2, lambda x, net=net: np.concatenate([[len(x), (v := losses(net, x, -1.0))[0]], _flat(v[1])]))
        n = max(1.0, got[0])
        good, d_good, bad, d_bad = trusted(net)
        rest = got[1] / n - prior * bad
        now = prior * good + max(0.0, rest) + decay(net)
        grad = prior * d_good + (got[2:] / n - prior * d_bad if rest > 0 else 0.0)
        grad = grad + 1e-4 * _flat({k: getattr(net, k) if k[0] == "w" else np.zeros_like(getattr(net, k)) for k in NAMES})
        weights = _flat({k: getattr(net, k) for k in NAMES})
        if not np.abs(grad).max() > 0:
            break
        unit = -grad / np.linalg.norm(grad) * np.linalg.norm(weights)
        tried = [_moved(net, unit * reach * s) for s in (1.0, 0.3, 0.1, 0.03)]
        sums = _summed(written, len(tried), lambda x, tried=tried: np.array([losses(t, x, -1.0)[0] for t in tried]))
        risks = []
        for t, v in zip(tried, sums / n):
            good, _, bad, _ = trusted(t)
            risks.append(prior * good + max(0.0, v - prior * bad) + decay(t))
        best = int(np.argmin(risks))
        if risks[best] >= now:
            reach /= 30
            continue
        net, reach = tried[best], reach * (1.0, 0.3, 0.1, 0.03)[best] * 2
        release(written.sparkSession)  # else the driver's heap grows with the tasks of every pass
    for k in NAMES:
        setattr(net, k, np.asarray(getattr(net, k), np.float32))
    return net


def fit_pu(p: np.ndarray, u: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = 0,
           moments: tuple[np.ndarray, np.ndarray] | None = None) -> Network:
    """Minimise the non-negative risk over rows ``p`` (positive) and ``u`` (unlabelled) by Adam.  ``moments``: mean and
    deviation of the inputs, those of ``u`` if not given.  The rows stay as they are, in half precision if they come so;
    only those of a step are standardised."""
    rng = np.random.default_rng(seed)
    mean, sd = moments or (u.mean(axis=0, dtype=np.float32), u.std(axis=0, dtype=np.float32))
    scale = (1 / np.maximum(sd, 1e-3)).astype(np.float32)
    d = p.shape[1]
    net = Network(mean, scale, rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32),
                  rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32), np.float32(0))
    names = ("w1", "b1", "w2", "b2")
    m, v = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    t = 0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    steps = max(20, max(len(p), len(u)) // BATCH)
    for _ in range(epochs):
        for _ in range(steps):
            xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
            x = _standardised(np.concatenate([xp, xu]), mean, scale)
            h = np.tanh(x @ net.w1 + net.b1)
            g = h @ net.w2 + net.b2
            gp, gu = g[:BATCH], g[BATCH:]
            bad = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()  # risk on bad documents
            if bad >= 0:
                dp = prior * (-sig(-gp)) - prior * sig(gp)
                du = sig(gu)
            else:
                dp, du = prior * sig(gp), -sig(gu)
            dg = np.concatenate([dp / len(gp), du / len(gu)])
            dh = np.outer(dg, net.w2) * (1 - h * h)
            grads = {"w1": x.T @ dh + 1e-4 * net.w1, "b1": dh.sum(axis=0), "w2": h.T @ dg + 1e-4 * net.w2, "b2": dg.sum()}
            t += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grads[k]
                v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
                step = 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, (getattr(net, k) - step).astype(np.float32))
    return net


def best_cut(g: np.ndarray, y: np.ndarray) -> float:
    """The value that separates the classes best (mean of the two hit rates), in the middle of the gap around it."""
    order = np.argsort(g, kind="stable")
    g, y = g[order], y[order]
    good, bad = max(1, (y == 1).sum()), max(1, (y == 0).sum())
    rate = np.concatenate([[0], np.cumsum(y == 0)]) / bad + 1 - np.concatenate([[0], np.cumsum(y == 1)]) / good
    edges = np.concatenate([[g[0] - 1], (g[1:] + g[:-1]) / 2, [g[-1] + 1]])
    return float(np.median(edges[rate >= rate.max() - 1e-12]))


def write_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the inputs of every whole text, written: one pass over the texts for all that follows."""
    return materialise(docs.select(ref(id_col).alias("id"), feature_udf()(ref(text_col)).alias("x")), "quality-features")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality",
          max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, max_negative: int = MAX_NEGATIVE,
          written: DataFrame | None = None) -> Network | None:
    """Fit on trusted positives and unlabelled text; None if there is no trusted positive.  ``max_negative`` bounds the
    labelled bad rows that only help to place the decision; ``written``: the documents' inputs, if they exist already."""
    chosen, counts = bounded_labels(training_labels(labels, label, id_col), {1: max_positive, 0: max_negative})
    if not counts[1]:
        return None
    prior, bound = counts[1] / (counts[0] + counts[1]), 2 * (max_positive + max_negative + max_unlabelled)
    if written is not None:
        return _train_on(written, chosen, prior, max_unlabelled, bound)
    written = write_features(docs, id_col, text_col)
    net = _train_on(written, chosen, prior, max_unlabelled, bound)
    drop_scratch(written)
    return net


def _train_on(written: DataFrame, chosen: DataFrame, prior: float, max_unlabelled: int, bound: int) -> Network | None:
    """Fit on the inputs of all documents and the (id, y) ``chosen``; ``bound``: rows of the sample at most."""
    release(written.sparkSession)
    # a few thousand (id, label) pairs, bounded by the parameters above
    rows = written.join(F.broadcast(chosen), "id", "left")
    free = F.coalesce(sample_by_hash(written, max_unlabelled, "id"), F.lit(False))
    rows = within_bound(rows.where(F.col("y").isNotNull() | free).select("id", "x", "y", free.alias("free")), bound)
    sample = rows.select(F.coalesce("y", F.lit(-1)).alias("y"), "free", "x").toArrow()
    if not len(sample):
        return None
    # in half precision, as they were written: these are the largest arrays of the driver
    x, y, u = _matrix(sample.column("x")), sample.column("y").to_numpy(), sample.column("free").to_numpy()
    del sample
    if not (y == 1).any():
        return None
    p = x[y == 1]
    moments = input_moments(written)
    release(written.sparkSession)
    net = fit_pu(p, x[u] if u.any() else x, prior, moments=moments)
    net = refine(net, written, p, prior)
    known = y >= 0
    g = net.g(x[known])
    # scale: one unit of the score's logit per typical deviation of g; place: the best cut scores CUT
    cut = best_cut(g, y[known]) if (y == 0).any() else float(np.quantile(g, 0.01))
    net.a = float(3 / max(1e-6, np.abs(g - cut).mean()))
    net.b = float(np.log(CUT / (1 - CUT)) - net.a * cut)
    del x, p, g
    trim()
    return net


def feature_udf():
    @F.pandas_udf("binary")
    def as_features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([features(t).astype(np.float16).tobytes() for t in batch])

    return as_features


def score_udf(spark, net: Network | None, as_written: bool = False):
    """Column function text, or its written inputs, -> score in 0..1, higher where a good document is likelier."""
    model = spark.sparkContext.broadcast(net)  # fixed size
    trim()

    @F.pandas_udf("double")
    def score(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in rows:
            found = []
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                if model.value is None:
                    found.append(np.full(len(part), 0.5))
                else:
                    x = [np.frombuffer(t, np.float16).astype(np.float32) if as_written else features(t) for t in part]
                    found.append(model.value.score(np.stack(x)).astype(np.float64))
            yield pd.Series(np.concatenate(found) if found else np.empty(0))

    return score


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """One row per input row: id, held_out, score, predicted."""
    written = write_features(docs, id_col, text_col)
    net = train(docs, labels, id_col, text_col, **bounds, written=written)
    scored = written.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), score_udf(docs.sparkSession, net, as_written=True)("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """``docs`` without the rows that score below ``CUT``."""
    net = train(docs, labels, id_col, text_col, **bounds)
    return docs.where(score_udf(docs.sparkSession, net)(ref(text_col)) >= CUT)
