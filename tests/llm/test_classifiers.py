"""Classifiers: held-out accuracy, what they may look at, odd inputs, and their numeric parts against plain code."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablab.llm import quality_classifier as Q
from tablab.llm import toxicity as T
from tablab.llm.labelled import bounded_labels, held_out, training_labels
from tablab.llm.queries import QUERIES


def rates(spark, name, sf, label):
    rows = QUERIES[name](spark, sf)
    assert rows.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = rows.toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    assert (out.held_out == out.doc_id.map(lambda k: zlib.crc32(str(k).encode()) % 5 == 0)).all()
    out = out[out.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    hit = out[out[label] == 1].predicted.mean()
    alarm = out[out[label] == 0].predicted.mean()
    return hit, alarm


def test_quality_on_held_out_documents(spark):
    good, bad = rates(spark, "op6_quality_classifier", "/root/testdata/sf0.1", "quality")
    assert good > 0.98 and bad < 0.05


def test_toxicity_on_held_out_documents(spark):
    hit, alarm = rates(spark, "op7_toxicity", "/root/testdata/sf0.1", "toxic")
    assert hit > 0.8 and alarm < 0.03


@pytest.fixture
def odd(spark):
    texts = [None, "", "plain words in a line.", "PLAIN!! WORDS!!", "x " * 200_000, "é" * 50]
    docs = spark.createDataFrame([(i if i % 4 else None, t, "s", 1.5) for i, t in enumerate(texts * 6)], "doc_id long, text string, score string, y double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 2), "x") for i in range(1, 36)] + [(1, 0, 0, "x"), (2, None, None, "x"), (None, 1, 1, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    return docs, labels


@pytest.mark.parametrize("score, keep", [(Q.score_quality, Q.keep_good), (T.score_toxicity, T.drop_toxic)])
def test_odd_inputs(spark, odd, score, keep):
    docs, labels = odd
    for lab in (labels, labels.limit(0), labels.where("quality = 0 and toxic = 0")):
        rows = score(docs, lab).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    kept = keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert score(docs.limit(0), labels).count() == 0 and keep(docs.limit(0), labels).count() == 0
    same = docs.select("doc_id", F.lit("one text for all").alias("text"))
    assert len({r.score for r in score(same, labels).collect()}) == 1


def test_labels_of_held_out_rows_are_never_read(spark, odd):
    _, labels = odd
    train = training_labels(labels, "quality").collect()
    assert train and all(zlib.crc32(str(r.id).encode()) % 5 for r in train)
    assert {r.id: r.y for r in train}.get(1, 0) == 0
    flipped = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(training_labels(flipped, "quality").collect()) == sorted(train)


def test_sample_is_bounded(spark):
    labels = spark.range(50_000).selectExpr("id", "cast(id % 5 = 0 as int) as y")
    chosen, counts = bounded_labels(labels, {0: 1000, 1: 300})
    assert counts == {0: 40_000, 1: 10_000}
    n = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    assert 850 < n[0] < 1150 and 230 < n[1] < 370


def test_toxicity_sample_is_bounded_in_words(spark):
    docs = spark.range(200).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), cast(if(id = 7, 100000, 1000) as int)) as text")
    chosen = spark.range(200).selectExpr("id", "cast(id % 2 as int) as y")
    get = lambda words: T.training_sample(docs, chosen, {1: 100, 0: 100}, words, "doc_id", "text")
    assert len(get(T.MAX_WORDS)) == 200
    few = get(40_000)
    assert {r.id: len(r.x) // 8 for r in few} == {r.id: 1000 for r in few}  # whole, and not the one that cannot fit
    assert sorted(r.y for r in few) == [0] * 20 + [1] * 20
    more = {r.id for r in get(80_000)}
    assert {r.id for r in few} < more and len(more) == 80
    repeated = docs.where("doc_id < 100").withColumn("text", F.lit("")).withColumn("doc_id", F.col("doc_id") % 4).crossJoin(spark.range(100))
    assert len(T.training_sample(repeated, chosen, {1: 2, 0: 2}, T.MAX_WORDS, "doc_id", "text")) <= 8


def test_toxicity_trains_within_its_words(spark, monkeypatch):
    docs = spark.range(60).selectExpr("id as doc_id", "repeat(if(id % 2 = 0, 'bad word ', 'kind word '), 500) as text")
    labels = spark.range(60).selectExpr("id as doc_id", "cast(id % 2 = 0 as int) as toxic")
    seen = []
    monkeypatch.setattr(T, "fit", lambda texts, y, fit=T.fit: seen.append(sum(map(len, texts))) or fit(texts, y))
    assert T.train(docs, labels, max_words=20_000) is not None
    assert 10_000 <= seen[0] <= 20_000


def test_quality_inputs_are_scaled_over_all_documents(spark):
    texts = [None, "", "One line here.", "x " * 5000, *(f"Some words, number {i}, of a plain text.\n" * (i % 7 + 1) for i in range(400))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    labels = spark.range(404).selectExpr("id as doc_id", "cast(id % 3 > 0 as int) as quality")
    x = np.stack([Q.features(t) for t in texts]).astype(np.float64)
    net = Q.train(docs, labels, max_unlabelled=20, max_positive=30, max_negative=10)
    assert np.allclose(net.mean, x.mean(axis=0), rtol=1e-5, atol=1e-7)
    assert np.allclose(1 / net.scale, np.maximum(x.std(axis=0), 1e-3), rtol=1e-4, atol=1e-6)


def test_pu_risk_learns_without_negatives():
    rng = np.random.default_rng(0)
    d, prior = Q.N_RATES, 0.7
    draw = lambda n, good: (rng.normal(0, 1, (n, d)) + (1.5 if good else -1.5) * np.eye(1, d)).astype(np.float32)
    p, u = draw(1500, True), np.concatenate([draw(2100, True), draw(900, False)])
    net = Q.fit_pu(p, u, prior, epochs=15)
    good, bad = net.g(draw(1000, True)), net.g(draw(1000, False))
    cut = Q.best_cut(np.concatenate([good, bad]), np.repeat([1, 0], 1000))
    assert (good > cut).mean() > 0.85 and (bad < cut).mean() > 0.85 and abs(cut) < 1.5


def test_quality_features():
    x = Q.features("A b. " * 30 + "\n" + "A b. " * 30)
    assert x.shape == (Q.N_RATES + Q.BUCKETS,) and np.isfinite(x).all()
    assert Q._repeated_share(np.arange(50, dtype=np.uint64), 5) == 0
    assert Q._repeated_share(np.tile(np.arange(5, dtype=np.uint64), 4), 5) == 1 - 5 / 16
    big = "ab c" * 600_000  # longer than a piece
    assert np.isfinite(Q.features(big)).all()


def test_maxima_are_those_of_plain_convolution():
    net = T.Convolution(1)
    rng = np.random.default_rng(2)
    net.words[:] = rng.normal(size=net.words.shape)
    net.starts[:] = rng.normal(size=net.starts.shape)
    texts = [T.words_of(t) for t in ("", "one", "a few words here", "many " * 9, None)]
    want = np.zeros((len(texts), T.FILTERS * len(T.WIDTHS)), np.float32)
    for i, t in enumerate(texts):
        x = np.concatenate([net.words[t & 0xFFFFFFFF] + net.starts[t >> 32], np.zeros((2, T.DIM), np.float32)])
        for n, (k, f) in enumerate(zip(T.WIDTHS, net.filters)):
            for s in range(len(t)):
                part = x[s : s + k]
                want[i, n * T.FILTERS : (n + 1) * T.FILTERS] = np.maximum(
                    want[i, n * T.FILTERS : (n + 1) * T.FILTERS], sum(part[j] @ f[j] for j in range(k)))
    assert np.allclose(np.maximum(net.maxima(texts), 0), want, atol=1e-4)


def test_long_texts_are_scored_whole():
    net = T.Convolution(1)
    net.words[T.words_of("awful")[0] & 0xFFFFFFFF, 0] = 5
    net.thresholds[:] = 1
    calm, loud = T.words_of("calm " * 200_000), T.words_of("calm " * 200_000 + "awful")
    assert net.scores([calm])[0] < 0.5 < net.scores([loud])[0]
    assert net.logits([loud])[0] == pytest.approx(net.logits([T.words_of("calm calm calm awful")])[0], abs=1e-3)


def test_language_guess():
    said = {"en": "the cat and the dog", "de": "der Hund und die Katze", "fr": "le chat et les chiens", "es": "el perro y los gatos", "other": "zzz qqq"}
    assert {k: T.LANGUAGES[T.language_of(T.words_of(v))] for k, v in said.items()} == {k: k for k in said}


def test_risk_gradient_is_that_of_differences():
    rng = np.random.default_rng(3)
    d = Q.N_RATES + Q.BUCKETS
    x = rng.normal(size=(40, d)).astype(np.float32)
    net = Q.Network(np.zeros(d), np.ones(d), rng.normal(0, 0.2, (d, Q.HIDDEN)), rng.normal(size=Q.HIDDEN), rng.normal(size=Q.HIDDEN), np.array(0.3))
    for sign in (1.0, -1.0):
        flat = Q._flat(Q.losses(net, x, sign)[1])
        for at in rng.integers(0, len(flat), 25).tolist() + [len(flat) - 1]:
            step = np.zeros(len(flat))
            step[at] = 1e-5
            slope = (Q.losses(Q._moved(net, step), x, sign)[0] - Q.losses(Q._moved(net, -step), x, sign)[0]) / 2e-5
            assert slope == pytest.approx(flat[at], rel=1e-4, abs=1e-6)


def test_last_steps_lower_the_risk_over_all_documents(spark):
    """Whatever the sample that a fit starts on, the whole corpus decides on its end."""
    texts = [(f"Plain words here, number {i}.\n" if i % 3 else f"|| {i} $$ ## AB{i}") * (i % 5 + 1) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    written = Q.write_features(docs)
    x = np.stack([Q.features(t) for t in texts])
    p, prior = x[np.arange(600) % 3 > 0][:100], 0.6

    def risk(net):
        good, bad = Q.losses(net, p, 1.0)[0] / len(p), Q.losses(net, p, -1.0)[0] / len(p)
        return prior * good + max(0.0, Q.losses(net, x, -1.0)[0] / len(x) - prior * bad) + 0.5e-4 * (np.square(net.w1).sum() + np.square(net.w2).sum())

    start = Q.fit_pu(p, x[:20], prior, epochs=1, moments=Q.input_moments(written))
    end = Q.refine(start, written, p, prior, rounds=3)
    assert risk(end) < risk(start)
    assert risk(Q.refine(end, written, p, prior, rounds=1)) <= risk(end) + 1e-9


def test_toxicity_learns_from_labelled_rows_beyond_its_sample(spark, monkeypatch):
    """A word that only few toxic documents have is learnt whether or not the sample holds one of them."""
    monkeypatch.setattr(T, "SHARD_WORDS", 4000)
    labels = spark.range(3000).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic")
    bounds = {"max_toxic": 12, "max_clean": 24}
    chosen, _ = bounded_labels(training_labels(labels, "toxic"), {1: 12, 0: 24})
    rare = ~F.col("doc_id").isin([r.id for r in chosen.collect()]) & (F.col("doc_id") % 30 == 0)  # the sample does not know the word
    insult = F.when(rare, "rareinsult").when(F.col("doc_id") % 3 == 0, "commoninsult").otherwise("calm")
    docs = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("text", F.concat_ws(" ", F.lit("plain words here"), F.col("doc_id") % 40, insult, F.lit("and more")))
    net = T.train(docs, labels, **bounds)
    got = net.scores([T.words_of(f"plain words here 7 {w} and more") for w in ("rareinsult", "commoninsult", "calm")])
    assert got[0] > 0.5 and got[1] > 0.5 and got[2] < 0.5
    again = T.train(docs.repartition(7), labels.repartition(3), **bounds)
    assert np.allclose(net.thresholds, again.thresholds, atol=1e-2) and np.allclose(net.out, again.out, atol=1e-4)


def test_quality_fit_keeps_its_sample_in_half_precision():
    """The driver holds the sample as it was written, not standardised copies of it."""
    import tracemalloc

    rng = np.random.default_rng(0)
    x = rng.random((6000, Q.N_RATES + Q.BUCKETS)).astype(np.float16)
    moments = x.mean(axis=0, dtype=np.float32), x.std(axis=0, dtype=np.float32)
    tracemalloc.start()
    half = Q.fit_pu(x[:2000], x[2000:], 0.5, epochs=1, moments=moments)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * x.nbytes
    single = Q.fit_pu(x[:2000].astype(np.float32), x[2000:].astype(np.float32), 0.5, epochs=1, moments=moments)
    assert np.array_equal(half.w1, single.w1) and np.array_equal(half.g(x), single.g(x.astype(np.float32)))


def test_toxicity_sample_stays_in_its_buffers(spark):
    docs = spark.createDataFrame([(1, "some words"), (1, ""), (2, None), (3, "more")], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, 1), (2, 0)], "id long, y int")
    got = T.training_sample(docs, chosen, {1: 10, 0: 10}, T.MAX_WORDS, "doc_id", "text")
    assert sorted((r.id, r.y, len(r.x) // 8) for r in got) == [(1, 1, 0), (1, 1, 2), (2, 0, 0)]
    assert all(isinstance(r.x, memoryview) for r in got) and len(np.frombuffer(got[0].x, np.int64)) == len(got[0].x) // 8
    assert len({r.aside for r in got if r.id == 1}) == 1
