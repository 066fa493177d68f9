"""Bounded chart frames and quantiles of many columns, against plain Python."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablab.functions.names import private
from tablab.operators import charts as G
from tablab.operators import quantiles as Q
from tablab.operators.reduction import line_envelope, sample_points


def envelope(rows, most):
    """rows: (x, y, series)."""
    by, out = defaultdict(list), set()
    for r in rows:
        by[r[2]].append(r)
    for s, rs in by.items():
        if len(rs) <= most:
            out |= {(*r, i) for i, r in enumerate(rs)}
            continue
        xs = [r[0] for r in rs if r[0] is not None]
        low, high, buckets = min(xs, default=0), max(xs, default=0), defaultdict(list)
        for x, y, _ in rs:
            if x is not None and y is not None:
                buckets[min(math.floor((x - low) / (high - low) * (most // 4)), most // 4 - 1) if high > low else 0].append((x, y))
        for b in buckets.values():
            flip = [(y, x) for x, y in b]
            out |= {(x, y, s, 0) for x, y in (min(b), max(b), min(flip)[::-1], max(flip)[::-1])}
    return Counter((x, y, s) for x, y, s, _ in out)


def test_line_keeps_ends_and_extremes(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), float(y), s) for s, n in (("a", 2000), (None, 500), ("few", 30)) for x, y in zip(rng.exponential(10, n).round(2), rng.normal(size=n).round(2))]
    rows += [(None, 1.0, "a"), (3.0, None, "a"), (5.0, 99.0, "a"), (5.0, 99.0, "a"), (None, None, "few")] + [(7.0, 1.0, "flat")] * 100
    df = spark.createDataFrame([(*r, 1) for r in rows], "__at double, y double, __n string, extra int")  # the operator's own helper names
    for parts in (1, 5):
        got = Counter(map(tuple, line_envelope(df.repartition(parts), "__at", "y", ["__n"], 60).collect()))
        assert got == envelope(rows, 60)
    ordered = G.line_data(df, "__at", "y", color="__n", max_points=60).collect()
    assert [r[0] for r in ordered] == sorted([r[0] for r in ordered], key=lambda v: (v is None, v))
    assert max(Counter(r[2] for r in ordered).values()) <= 60
    assert line_envelope(df.limit(0), "__at", "y", [], 8).count() == 0
    with pytest.raises(ValueError):
        line_envelope(df, "__n", "y")
    with pytest.raises(ValueError):
        line_envelope(df, "__at", "y", max_points=3)


def bottom(rows, most, facet, seed=42):
    import hashlib

    def h(r):
        return int(hashlib.md5("-".join([str(v) for v in r if v is not None] + [str(seed)]).encode()).hexdigest()[:8], 16)

    by = defaultdict(list)
    for r in rows:
        by[facet(r)].append(r)
    return Counter(r for rs in by.values() for r in sorted(rs, key=lambda r: (h(r), r))[:most])


def test_points_are_the_smallest_hashes(spark):
    rows = [(i, f"f{i % 3}" if i % 7 else None) for i in range(3000)] + [(-1, "hot")] * 2000 + [(i, "hot") for i in range(900)] + [(1, "one")]
    df = spark.createDataFrame(rows, "x long, f string")
    for most in (1, 40, 700):
        got = Counter(map(tuple, sample_points(df.repartition(4), ["x", "f"], most, ["f"]).collect()))
        assert got == bottom(rows, most, lambda r: r[1])
    whole = Counter(map(tuple, sample_points(df, ["x", "f"], 100).collect()))
    assert whole == bottom(rows, 100, lambda r: None)
    assert sample_points(df.limit(0), ["x"], 5, ["f"]).count() == sample_points(df.limit(0), ["x"], 5).count() == 0
    assert sample_points(df, ["x"], 10**6, ["f"]).count() == len(rows)


def test_points_of_mostly_equal_rows(spark):
    """All rows of a facet equal, their hash above any first threshold: the threshold is raised until they pass."""
    rows = [(v, f"g{v}") for v in range(12) for _ in range(3000)]
    got = Counter(map(tuple, sample_points(spark.createDataFrame(rows, "x long, f string"), ["x", "f"], 5, ["f"]).collect()))
    assert got == Counter({(v, f"g{v}"): 5 for v in range(12)})


def exact(v, p):
    v = np.sort(v)
    h = (len(v) - 1) * p
    a, b = v[math.floor(h)], v[math.ceil(h)]
    return a if a == b else a + (b - a) * (h - math.floor(h))


@pytest.mark.parametrize("values,parts", [(200_000, 8192), (64, 64)])
def test_quantiles_of_odd_columns(spark, monkeypatch, values, parts):
    """Few values read and few parts counted force several narrowing passes; results do not change."""
    monkeypatch.setattr(Q, "VALUES", values)
    monkeypatch.setattr(Q, "PARTS", parts)
    rng, n = np.random.default_rng(6), 30_000
    cols = {
        "wide": np.exp(rng.normal(size=n) * 40), "ties": np.floor(rng.exponential(2, n)), "zeros": np.where(rng.random(n) < 0.9, 0.0, -rng.random(n)),
        "inf": np.where(rng.random(n) < 0.3, np.inf, rng.random(n)), "_v": rng.integers(-(2**53), 2**53, n).astype(float), "one": np.full(n, 3.5),
        "tiny": rng.random(n) * 5e-324 * 2**40, "some": np.where(rng.random(n) < 0.5, np.nan, rng.random(n)), "a.b": rng.random(n),
    }
    df = spark.createDataFrame([tuple(float(x) for x in r) for r in zip(*cols.values())], list(cols)).withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    got = Q.column_quantiles(df, [*cols, "none"], probs)
    for c, v in cols.items():
        assert got[c] == pytest.approx([exact(v[~np.isnan(v)], p) for p in probs], rel=1e-12), c
    assert got["none"] == [None] * len(probs)
    assert Q.column_quantiles(df, [], probs) == {} and Q.column_quantiles(df, ["one"], []) == {"one": []}


def test_order_of_doubles():
    values = [-math.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1e300, math.inf]
    assert [Q._double(Q._ordered(v)) for v in values] == values
    assert sorted(values, key=Q._ordered) == values
    assert Q._edges(2.0, 2.0, 16).tolist() == [2.0] and Q._edges(-1.0, 1.0, 4)[[0, -1]].tolist() == [-1.0, 1.0]


def test_private_names():
    assert private(["__A", "b"], "a", "a", "b") == ["__a_1", "__a_2", "__b"]
