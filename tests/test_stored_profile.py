"""Stored profiles: merged states against the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablab.operators import stored_profile as S


@pytest.fixture(scope="module")
def table(spark):
    rng, n = np.random.default_rng(8), 40_000
    rows = [(int(i), float(x), float(o), int(g) if g else None, f"t{i % 700}" if i % 9 else None, [int(i % 5)]) for i, (x, o, g) in
            enumerate(zip(rng.lognormal(0, 3, n), 1e9 + rng.random(n), rng.integers(0, 12, n)))]
    rows += [(n, float("nan"), None, 3, "", None), (n + 1, None, float("nan"), None, None, [1])]
    return spark.createDataFrame(rows, "id long, x double, `off set` double, slice int, text string, list array<int>").withColumn("none", F.lit(None).cast("double"))


def facts(states):
    return {r.column_name: r for r in S.read_state(states, [0.01, 0.5, 0.99]).collect()}


def test_merged_equals_whole(table):
    whole, merged = facts(S.profile_state(table)), facts(S.merge_states(S.profile_state(table, "slice")))
    two = facts(S.merge_states(S.merge_states(S.profile_state(table.where("slice < 5"), "slice")).unionByName(S.profile_state(table.where("slice >= 5 or slice is null"), "slice"))))
    assert set(whole) == set(table.columns)
    for c, w in whole.items():
        for m in (merged[c], two[c]):
            for f in ("dtype", "n_rows", "n_null", "count", "min", "max", "first_text", "last_text", "position"):
                assert w[f] == m[f], (c, f)
            if w["mean"] is None:
                assert m["mean"] is None and m["std"] is None
                continue
            assert m["mean"] == pytest.approx(w["mean"]) and m["std"] == pytest.approx(w["std"], rel=1e-6)
    assert whole["x"].n_null == 2 and whole["none"]["count"] == 0 and whole["none"]["p50"] is None
    # a small deviation around a large offset survives the merge
    assert merged["off set"]["std"] == pytest.approx(np.std([r[0] for r in table.select("off set").where("id < 40000").collect()], ddof=1), rel=1e-6)


def test_errors_within_the_stated_bounds(table):
    merged = facts(S.merge_states(S.profile_state(table, "slice")))
    for c in ("x", "id", "off set"):
        v = np.sort([r[0] for r in table.select(F.col(f"`{c}`").cast("double")).collect() if r[0] is not None and r[0] == r[0]])
        for p, name in ((0.01, "p1"), (0.5, "p50"), (0.99, "p99")):
            got = merged[c][name]
            assert np.searchsorted(v, got, "left") / len(v) - S.RANK_ERROR <= p <= np.searchsorted(v, got, "right") / len(v) + S.RANK_ERROR
    for c, n in (("id", 40_002), ("text", 701), ("slice", 11), ("list", 5)):
        true = table.select(F.col(c).cast("string")).distinct().where(F.col(c).isNotNull()).count()
        assert abs(merged[c].n_distinct - true) <= max(1, S.DISTINCT_ERROR * true) * 2, (c, n)


def test_a_reloaded_slice_counts_once(table):
    stored = S.profile_state(table, "slice")
    again = S.profile_state(table.where("slice = 3 or slice is null"), "slice")
    assert facts(S.merge_states(S.replace_slices(stored, again)))["x"].n_rows == table.count()
    assert facts(S.merge_states(stored.unionByName(again)))["x"].n_rows > table.count()


def test_ranks_changed_types_and_empty_tables(table, spark):
    ranks = {r.value: r["rank"] for r in S.rank_of(S.merge_states(S.profile_state(table, "slice", ["id"])), [-1, 20_000, 50_000]).collect()}
    assert ranks[-1.0] == 0 and ranks[50_000.0] == 1 and abs(ranks[20_000.0] - 0.5) < S.RANK_ERROR
    both = S.profile_state(table.select("id").limit(5)).unionByName(S.profile_state(table.select(F.col("id").cast("string")).limit(7)))
    assert sorted((r.dtype, r.n_rows) for r in S.merge_states(both).collect()) == [("bigint", 5), ("string", 7)]
    empty = S.profile_state(table.limit(0))
    assert S.read_state(S.merge_states(empty)).where("count > 0").count() == 0
    assert S.profile_state(spark.range(3).select()).count() == 0


def test_one_pass_for_any_number_of_columns(spark):
    wide = spark.range(2000).select("id", *[(F.col("id") * i % 97).cast("double").alias(f"c{i}") for i in range(60)])
    states = S.profile_state(wide, F.col("id") % 4)
    assert states.count() == 4 * 61
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1
