"""Running sums over a global order without an un-partitioned window.

``Window.orderBy(x)`` with no partition key moves every row into one task.
Instead the rows are cut into value ranges with a bounded-memory sketch
(``percentile_approx`` split points), each range gets its starting offset
from a table with one row per range, and the running sum inside a range is a
window partitioned by (keys, range).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges per shuffle partition.
RANGES = 4


def _null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null meets null; the right side's keys are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_k{keys.index(c)}") if c in keys else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for i, c in enumerate(keys):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return left.join(renamed, cond, how).drop(*[f"_k{i}" for i in range(len(keys))])


def _ranged(g: DataFrame, keys: Sequence[str], ranges: int | None) -> DataFrame:
    """Add ``_r``: the value range of ``_o``, by split points from a bounded sketch (per key, if there are keys)."""
    ranges = ranges or max(2, RANGES * int(g.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fracs = [i / ranges for i in range(1, ranges)]
    if keys:
        splits = g.groupBy(*keys).agg(F.percentile_approx("_o", fracs, 10000).alias("_splits"))
        return _null_safe_join(g, splits, keys).withColumn("_r", F.size(F.filter("_splits", lambda s: s < F.col("_o")))).drop("_splits")
    # global order: the (ranges - 1) split points are constants
    pts = g.agg(F.percentile_approx("_o", fracs, 10000).alias("_s")).collect()[0]["_s"] or []
    arr = F.array(*[F.lit(float(p)) for p in pts]) if pts else F.array().cast("array<double>")
    return g.withColumn("_r", F.size(F.filter(arr, lambda s: s < F.col("_o"))))


def with_next(df: DataFrame, order_col: str, cols: Sequence[str], keys: Sequence[str] = (), descending: bool = False,
              ranges: int | None = None) -> DataFrame:
    """Add ``next_<c>`` (null for the last row) for every c in ``cols`` and ``is_first``, in the order of the numeric
    ``order_col``, which is unique per key.  Rows look ahead inside their value range; the last of a range looks at the
    first of the next range that has any, from a table with one row per range."""
    keys, o = list(keys), F.col(order_col).cast("double")
    gb = _ranged(df.withColumn("_o", -o if descending else o), keys, ranges)
    own = F.struct(*[F.col(c).alias(c) for c in cols])
    firsts = gb.groupBy(*keys, "_r").agg(F.min_by(own, F.col("_o")).alias("_f"))
    across = Window.partitionBy(*keys).orderBy("_r")
    firsts = firsts.select(*keys, "_r", F.lead("_f").over(across).alias("_after"), F.lag("_r").over(across).isNull().alias("_head"))
    inside = Window.partitionBy(*keys, "_r").orderBy("_o")
    rows = gb.withColumn("_next", F.lead(own).over(inside)).withColumn("_n", F.row_number().over(inside))
    out = _null_safe_join(rows, firsts, [*keys, "_r"])
    for c in cols:
        out = out.withColumn(f"next_{c}", F.coalesce(F.col("_next"), F.col("_after"))[c])
    return out.withColumn("is_first", F.col("_head") & (F.col("_n") == 1)).drop("_o", "_r", "_after", "_head", "_next", "_n")


def running_sums(
    df: DataFrame,
    order_col: str,
    sum_cols: Sequence[str],
    keys: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum of c in the order of
    ``order_col``, ties summed together in one step) and ``total_<c>`` per key
    for every c in ``sum_cols``.  ``order_col`` must be numeric."""
    keys = list(keys)
    o = F.col(order_col).cast("double")
    ordv = (-o) if descending else o
    base = df.withColumn("_o", ordv)
    # one row per distinct order value: ties move together
    g = base.groupBy(*keys, "_o").agg(*[F.sum(c).alias(c) for c in sum_cols])
    gk = keys
    gb = _ranged(g, gk, ranges)
    rstat = gb.groupBy(*gk, "_r").agg(*[F.sum(c).alias(f"_rs_{c}") for c in sum_cols])
    wk = Window.partitionBy(*gk).orderBy("_r")
    wall = Window.partitionBy(*gk)
    for c in sum_cols:
        rstat = rstat.withColumn(f"_off_{c}", F.sum(f"_rs_{c}").over(wk) - F.col(f"_rs_{c}")).withColumn(
            f"total_{c}", F.sum(f"_rs_{c}").over(wall)
        )
    rstat = rstat.drop(*[f"_rs_{c}" for c in sum_cols])
    w = Window.partitionBy(*gk, "_r").orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = _null_safe_join(gb, rstat, gk + ["_r"])
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_off_{c}") + F.sum(c).over(w))
    drop = ["_r"] + [f"_off_{c}" for c in sum_cols]
    out = out.drop(*[d for d in drop if d in out.columns])
    return out.withColumn(order_col, (-F.col("_o")) if descending else F.col("_o")).drop("_o")
