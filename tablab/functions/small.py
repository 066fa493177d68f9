"""Guarded access to small, size-bounded results (fitted constants)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row


def collect_bounded(df: DataFrame, max_rows: int, what: str = "result", structural: bool = True) -> list[Row]:
    """Collect a small frame to the driver.

    ``structural=True``: the frame is bounded by construction (an aggregate
    over a schema-bounded key, a top-k, one row per bucket...), so it is
    collected in one job and the bound is asserted.  ``structural=False``:
    the size depends on the data (e.g. distinct values), so at most
    ``max_rows + 1`` rows are fetched and more than ``max_rows`` is an
    error instead of an unbounded transfer."""
    if structural:
        rows = df.collect()
    else:
        rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows; refusing to collect it to the driver")
    return rows


def one_row(df: DataFrame) -> Row:
    rows = collect_bounded(df, 1, "single-row aggregate")
    if not rows:
        raise ValueError("aggregate returned no row")
    return rows[0]
