"""Operators leave no scratch table behind that their result does not read."""

import corpus_pipeline as P

from tablab import session
from tablab.llm.common import materialise
from tablab.llm.substrings import repeated_spans
from tablab.session import drop_scratch, scratch_mark


def _left(since: int) -> list[str]:
    return [p.rsplit("/tablab-", 1)[1].rsplit("-", 1)[0] for p in session._scratch[since:]]


def _texts(spark, n=240):
    shared = " ".join(f"shared{i}" for i in range(120))
    rows = [(i, f"Words of text {i}, " * (3 + i % 5) + (shared + " " if i % 3 == 0 else "") + " ".join(f"w{i}x{j}" for j in range(60))) for i in range(n)]
    rows += [(n, None), (n + 1, rows[0][1])]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_classifiers_delete_their_inputs(spark, tmp_path):
    docs = _texts(spark)
    docs.selectExpr("doc_id", "cast(doc_id % 4 > 0 as int) quality", "cast(doc_id % 5 = 0 as int) toxic").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (P.quality, P.toxicity):
        before = scratch_mark()
        kept = stage(spark, docs, str(tmp_path))
        assert _left(before) == []
        assert kept.count() <= docs.count()


def test_windows_leave_the_spans_only(spark):
    docs = _texts(spark)
    for window in (35, 100):  # two levels, and four
        before = scratch_mark()
        found = repeated_spans(docs, window=window)
        assert _left(before) == ["spans"]
        assert found.count() == 80 and {r.n_removed for r in found.collect()} >= {120}
    empty = scratch_mark()
    assert repeated_spans(docs.limit(0)).count() == 0 and _left(empty) == ["spans"]


def test_other_scratch_tables_stay(spark):
    before, (one, other) = scratch_mark(), [materialise(spark.range(5), "stays") for _ in range(2)]
    drop_scratch(one, spark.range(3))
    assert _left(before) == ["stays"]
    assert other.count() == 5 and session._scratch[-1].endswith(other.inputFiles()[0].split("/")[-2])
