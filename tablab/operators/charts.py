"""Chart-data operators (G1-G11): the DataFrame behind each chart kind.

Drawing is left to any plotting tool; these return either ordered rows
(line, scatter) or small aggregated frames (bars, area stacks, boxes,
histograms, 2-D bin counts).  Optional ``color`` / ``facet_col`` /
``facet_row`` columns become extra grouping or output columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablab.functions.kinds import is_numeric_type, numeric_columns, require_columns, require_numeric
from tablab.functions.long import q
from tablab.functions.small import collect_bounded, one_row
from tablab.operators import profile as P
from tablab.operators.quantiles import quantiles_wide
from tablab.operators.reduction import line_envelope, sample_points


def _extras(*cols: str | None) -> list[str]:
    out: list[str] = []
    for c in cols:
        if c is not None and c not in out:
            out.append(c)
    return out


# -------------------------------------------------------- G1 / G4 rows
def line_data(df: DataFrame, x: str, y: str, color=None, facet_col=None, facet_row=None, max_points: int | None = None) -> DataFrame:
    """Rows (x, y, extras) ordered by x ascending, nulls last: a range-partitioned distributed sort.  With ``max_points``
    at most so many per series (colour and facets), which keep every end and extreme of a series
    (:func:`tablab.operators.reduction.line_envelope`)."""
    cols = _extras(x, y, color, facet_col, facet_row)
    require_columns(df, cols)
    rows = df.select(*[q(c) for c in cols]) if max_points is None else line_envelope(df, x, y, cols[2:], max_points)
    return rows.orderBy(F.asc_nulls_last(q(x)))


def scatter_data(df: DataFrame, x: str, y: str, color=None, facet_col=None, facet_row=None, max_points: int | None = None,
                 key: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """Rows (x, y, extras) ordered by x; with ``max_points`` a seeded sample of at most so many per facet
    (:func:`tablab.operators.reduction.sample_points`)."""
    if max_points is None:
        return line_data(df, x, y, color, facet_col, facet_row)
    cols = _extras(x, y, color, facet_col, facet_row)
    return sample_points(df, cols, max_points, _extras(facet_col, facet_row), key, seed).orderBy(F.asc_nulls_last(q(x)))


# -------------------------------------------------------- G2 / G3 bars
def bar_count_data(df: DataFrame, x: str) -> DataFrame:
    return P.value_counts(df, x)


def bar_agg_data(df: DataFrame, x: str, y: str, fn: str = "mean", color=None, facet_col=None, facet_row=None) -> DataFrame:
    """``fn(y)`` per x (and per color / facet values, which the reference's
    own grouping could not carry)."""
    return P.group_agg(df, _extras(x, color, facet_col, facet_row), y, fn)


# ------------------------------------------------------------- G5 area
def area_data(df: DataFrame, x: str, y: str, color: str | None = None, facet_col=None, facet_row=None) -> DataFrame:
    """Sum of y per (x, color, facets) plus the stacked top: the running sum
    over colors (ascending) within each x and facet.  The window holds one row
    per color, so it is bounded by the number of colors."""
    keys = _extras(x, color, facet_col, facet_row)
    require_columns(df, keys)
    require_numeric(df, [y])
    g = P.group_agg(df, keys, y, "sum", sort=False)
    if color is None:
        return g.withColumn("stack_top", F.col(y)).orderBy(*keys)
    w = Window.partitionBy(*[c for c in keys if c != color] or [x]).orderBy(F.asc_nulls_first(color))
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return g.withColumn("stack_top", F.sum(y).over(w)).orderBy(*keys)


# -------------------------------------------------------------- G6 box
BOX_FIELDS = ("n", "min", "q1", "median", "q3", "max", "lower_fence", "upper_fence", "whisker_low", "whisker_high", "n_outliers")


def box_data(df: DataFrame, x: str | None, y: str, color=None, facet_col=None, facet_row=None, k: float = 1.5) -> DataFrame:
    """Per group: n, min, q1, median, q3, max (exact, linear), fences
    q1 - k*IQR / q3 + k*IQR, whiskers (most extreme values inside the fences)
    and the number of points outside them.  A group column with the name of one
    of these comes back as ``group_<name>``."""
    keys = _extras(x, color, facet_col, facet_row)
    require_columns(df, keys)
    require_numeric(df, [y])
    own = [f"key{i}" for i in range(max(1, len(keys)))]  # names of its own on the way, the user's at the end
    present = F.lit(True)
    for c in keys:
        present = present & q(c).isNotNull()
    groups = [q(c).alias(n) for c, n in zip(keys, own)] or [F.lit("all").alias(own[0])]
    base = df.where(present).select(*groups, q(y).cast("double").alias("value"))
    qs = quantiles_wide(base, own, "value", [0.25, 0.5, 0.75], ["q1", "median", "q3"], bounded_keys=False)
    qs = qs.withColumn("lower_fence", F.col("q1") - k * (F.col("q3") - F.col("q1"))).withColumn(
        "upper_fence", F.col("q3") + k * (F.col("q3") - F.col("q1"))
    )
    v = F.col("value")
    inside = (v >= F.col("lower_fence")) & (v <= F.col("upper_fence"))
    per_group = ("q1", "median", "q3", "lower_fence", "upper_fence")
    stats = base.join(qs, own, "left").groupBy(*own).agg(
        F.count(v).alias("n"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        *[F.first(c, ignorenulls=True).alias(c) for c in per_group],
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(v.isNotNull() & ~inside).alias("n_outliers"),
    )
    out = stats.orderBy(*own) if keys else stats
    named = [F.col(n).alias(f"group_{c}" if c.lower() in BOX_FIELDS else c) for c, n in zip(keys, own)]
    return out.select(*named, *BOX_FIELDS)


# -------------------------------------------------------- G7 histogram
def histogram_bounds(df: DataFrame, x: str) -> tuple[float | None, float | None]:
    row = one_row(df.agg(F.min(q(x).cast("double")).alias("mn"), F.max(q(x).cast("double")).alias("mx")))
    return row["mn"], row["mx"]


def histogram_bin_expr(x, mn: float, mx: float, bins: int):
    """Equal-width bins over [mn, mx], left-closed, the last one closed."""
    w = (mx - mn) / bins
    if w == 0:
        return F.when(x.isNotNull(), F.lit(0))
    return F.least(F.floor((x - F.lit(mn)) / F.lit(w)), F.lit(bins - 1)).cast("int")


def histogram_data(df: DataFrame, x: str, bins: int = 20, color: str | None = None, density: bool = False) -> DataFrame:
    """(bin, bin_start, bin_end, count[, density]) per bin (and color).
    Without a color every bin is listed, empty ones with count 0."""
    require_numeric(df, [x])
    if bins < 1:
        raise ValueError("bins must be >= 1")
    mn, mx = histogram_bounds(df, x)
    spark = df.sparkSession
    if mn is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, count bigint")
    w = (mx - mn) / bins
    xb = histogram_bin_expr(q(x).cast("double"), mn, mx, bins)
    keys = _extras(color)
    counts = (
        df.where(q(x).isNotNull())
        .select(*[q(c) for c in keys], xb.alias("bin"))
        .groupBy("bin", *keys)
        .agg(F.count(F.lit(1)).alias("count"))
    )
    if not keys:
        # all bins from the (bounded) bin count, no join with the data needed
        all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
        counts = all_bins.join(counts, "bin", "left").fillna({"count": 0})
    out = counts.select(
        "bin",
        *keys,
        (F.lit(mn) + F.col("bin") * F.lit(w)).alias("bin_start"),
        (F.lit(mn) + (F.col("bin") + 1) * F.lit(w)).alias("bin_end"),
        F.col("count").cast("bigint").alias("count"),
    )
    if density:
        total = F.sum("count").over(Window.partitionBy(*keys)) if keys else F.sum("count").over(Window.partitionBy())
        out = out.withColumn("density", F.try_divide(F.col("count"), total * F.lit(w if w else 1.0)))
    return out.orderBy(*keys, "bin")


# ----------------------------------------------------- G10 distribution
def distribution_data(df: DataFrame, c: str, bins: int = 20) -> DataFrame:
    """Histogram and box (in columns of their own, the same on every row) for
    a numeric column, value counts otherwise."""
    require_columns(df, [c])
    if is_numeric_type(df.schema[c].dataType):
        box = collect_bounded(box_data(df, None, c), 1, "box")
        parts = ("q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")
        kind = lambda n: "bigint" if n == "n_outliers" else "double"
        lits = [F.lit(box[0][n] if box else None).cast(kind(n)).alias(n if n == "n_outliers" else f"box_{n}") for n in parts]
        return histogram_data(df, c, bins).select("*", *lits)
    return P.value_counts(df, c)


# --------------------------------------------------- G9 scatter matrix
def scatter_matrix_data(
    df: DataFrame, cols: Sequence[str] | None = None, color: str | None = None, bins: int | None = None,
    max_points: int | None = None, key: Sequence[str] | None = None, seed: int = 42,
) -> DataFrame:
    """Rows of the selected columns (default: first 4 numeric) and color, with
    ``max_points`` a seeded sample of at most so many of them; with
    ``bins`` the 2-D bin counts (x_col, y_col, x_bin, y_bin, count) for every
    off-diagonal pair instead, aggregated map-side in one pass."""
    cols = list(numeric_columns(df)[:4] if cols is None else cols)
    if len(cols) < 2:
        raise ValueError("a scatter matrix needs at least two columns")
    require_numeric(df, cols)
    if bins is None and max_points is not None:
        return sample_points(df, _extras(*cols, color), max_points, (), key, seed)
    if bins is None:
        return df.select(*[q(c) for c in _extras(*cols, color)])
    row = one_row(df.agg(*[F.min(q(c).cast("double")).alias(f"mn{i}") for i, c in enumerate(cols)],
                         *[F.max(q(c).cast("double")).alias(f"mx{i}") for i, c in enumerate(cols)]))
    b = {}
    for i, c in enumerate(cols):
        mn, mx = row[f"mn{i}"], row[f"mx{i}"]
        b[c] = histogram_bin_expr(q(c).cast("double"), mn, mx, bins) if mn is not None else F.lit(None).cast("int")
    pairs = [
        F.struct(F.lit(a).alias("x_col"), F.lit(bc).alias("y_col"), b[a].alias("x_bin"), b[bc].alias("y_bin"))
        for a in cols
        for bc in cols
        if a != bc
    ]
    keys = _extras(color)
    exploded = df.select(*[q(c) for c in keys], F.inline(F.array(*pairs)))
    exploded = exploded.where(F.col("x_bin").isNotNull() & F.col("y_bin").isNotNull())
    return exploded.groupBy("x_col", "y_col", *keys, "x_bin", "y_bin").agg(F.count(F.lit(1)).alias("count"))


# ------------------------------------------------------- G8 / G11
def heatmap_data(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Correlation heatmap data (default: first 6 numeric columns)."""
    cols = list(numeric_columns(df)[:6] if cols is None else cols)
    return P.correlation_matrix(df, cols)


def null_bars_data(df: DataFrame) -> DataFrame:
    return P.null_report(df, only_with_nulls=True)
