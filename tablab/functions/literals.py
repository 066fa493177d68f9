"""Large constant expressions built as one SQL string.

Building a 2,000-element literal array (or a 250-branch CASE) through
``F.lit``/``F.when`` costs one driver-JVM round trip per node; the same
expression as SQL text is parsed once.  Doubles are written in exponent
form with 17 significant digits, which Spark SQL reads back as exactly the
same double.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dbl(x: float) -> str:
    x = float(x)
    if math.isnan(x):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(x):
        return "CAST('Infinity' AS DOUBLE)" if x > 0 else "CAST('-Infinity' AS DOUBLE)"
    return "%.17E" % x


def array_sql(values: Sequence[float]) -> str:
    return "array(" + ", ".join(dbl(v) for v in values) + ")" if len(values) else "CAST(array() AS array<double>)"


def lit_array(values: Sequence[float]) -> Column:
    return F.expr(array_sql(values))


def lit_matrix(rows: Sequence[Sequence[float]]) -> Column:
    return F.expr("array(" + ", ".join(array_sql(r) for r in rows) + ")")
