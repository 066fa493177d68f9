"""Every pipeline stage against its operator's decisions or brute force, on that stage's own input."""

from collections import Counter

import corpus_pipeline as P
import pytest
from test_packing import check as check_packing
from test_simhash import brute_components, brute_print
from test_substrings import brute as brute_substrings

from tablab.llm.common import materialise
from tablab.llm.quality_classifier import score_quality
from tablab.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        docs = materialise(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def test_stages(spark, outputs):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "toxicity", "simhash_near_dedup", "substring_dedup", "best_fit_packing"]
    first, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for rows in outputs[:4]:
        assert rows.columns == first.columns and rows.dtypes == first.dtypes

    good = {r.doc_id for r in score_quality(first, labels).where("predicted = 1").collect()}
    assert sorted(outputs[0].collect()) == sorted(r for r in first.collect() if r.doc_id in good)

    calm = {r.doc_id for r in score_toxicity(outputs[0], labels).where("predicted = 0").collect()}
    assert sorted(outputs[1].collect()) == sorted(r for r in outputs[0].collect() if r.doc_id in calm)

    rows = outputs[1].collect()
    heads = set(brute_components([(r.doc_id, brute_print(r.text)) for r in rows], 2))
    assert sorted(outputs[2].collect()) == sorted(r for r in rows if r.doc_id in heads)

    rows = outputs[2].collect()
    want = Counter((r.doc_id, kept if gone else r.text) for r, (_, gone, kept) in zip(rows, brute_substrings([r.text for r in rows], 35)))
    after = outputs[3].collect()
    assert Counter((r.doc_id, r.text) for r in after) == want
    assert all(r.n_chars == len(r.text) for r in after)

    check_packing(outputs[4].collect(), [(r.doc_id, r.text) for r in after])


def test_run_gives_the_last_stage(spark, outputs):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, P.run(spark, SF).select(columns).collect())) == Counter(map(tuple, outputs[-1].select(columns).collect()))


def test_odd_documents(spark):
    texts = [None, "", "word " * 20000, "Plain prose here, with a stop. " * 4, "Plain prose here, with a stop. " * 4, "x"]
    rows = [(i if i % 3 else None, t, "en", None, None if t is None else len(t), "extra") for i, t in enumerate(texts * 2)] + [(1, "", "en", "s", 0, "extra")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for start in (docs, docs.limit(0)):
        at = start
        for _, stage in P.STAGES:
            at = materialise(stage(spark, at, SF), "odd-stage")
        assert at.count() <= 100
