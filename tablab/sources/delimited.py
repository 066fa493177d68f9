"""Delimited text sources and sinks.

Reading is two steps:

1. dialect: one distributed pass over all lines decides the encoding (UTF-8,
   or ISO-8859-1 if any line is not valid UTF-8) and whether quoted fields span
   lines (any line with an odd number of quotes); the header decides the
   separator (',' then ';' with decimal comma, then tab: the first that gives
   more than one column);
2. one distributed read of every column as text, then a single aggregate
   pass that decides per column whether all non-missing values parse as
   integers or numbers (after turning a decimal comma into a point), and a
   projection with those casts.  Missing-value words become NULL, and so does
   any text that reads as NaN.  Pass ``schema_types`` to skip the inference.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablab.functions.long import q
from tablab.functions.small import one_row
from tablab.sources.tables import nan_to_null

# Fixed words that count as missing, besides the empty field.
NULL_TOKENS = (
    "?", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
HEADER_LINES = 20
# Fixed dialect candidates, tried in this order: (separator, decimal mark)
DIALECTS = ((",", "."), (";", ","), ("\t", "."))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path)


def _header(spark: SparkSession, path: str, encoding: str) -> list[str]:
    """The lines a header can stand on."""
    raw = _lines(spark, path).select(F.col("value").cast("binary").alias("b")).limit(HEADER_LINES).collect()
    return [bytes(r["b"]).decode(encoding, "replace") for r in raw]


def _columns(lines: list[str], sep: str) -> int:
    if not lines:
        return 0
    try:
        header = next(csv.reader(io.StringIO("\n".join(lines)), delimiter=sep))
    except (csv.Error, StopIteration):
        return 0
    return len(header)


def sniff(spark: SparkSession, path: str, sep: str | None = None, decimal: str | None = None,
          encoding: str | None = None) -> dict:
    """{'sep', 'decimal', 'encoding', 'multiline'}; encoding and multiline
    come from every line."""
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    seen = one_row(_lines(spark, path).agg(
        F.count_if(~F.is_valid_utf8("value")).alias("broken"), F.count_if(quotes % 2 == 1).alias("open")
    ))
    if encoding is None:
        encoding = "ISO-8859-1" if seen["broken"] else "UTF-8"
    lines = _header(spark, path, encoding)
    if sep is None:
        chosen = None
        for s, d in DIALECTS:
            if _columns(lines, s) > 1:
                chosen = (s, d)
                break
        sep, dec = chosen or DIALECTS[0]
        decimal = decimal or dec
    decimal = decimal or ("," if sep == ";" else ".")
    return {"sep": sep, "decimal": decimal, "encoding": encoding, "multiline": seen["open"] > 0}


def _normalized(c, decimal: str):
    return F.regexp_replace(c, ",", ".") if decimal == "," else c


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    decimal: str | None = None,
    encoding: str | None = None,
    null_tokens: Sequence[str] = NULL_TOKENS,
    as_string: bool = False,
    schema_types: dict[str, str] | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """Read CSV/TSV/semicolon files (any Hadoop-FS path or glob) into a
    DataFrame with integer, double or string columns."""
    d = sniff(spark, path, sep, decimal, encoding)
    ml = d["multiline"] if multiline is None else multiline
    raw = (
        spark.read.option("header", True)
        .option("sep", d["sep"])
        .option("encoding", d["encoding"])
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", ml)
        .option("inferSchema", False)
        .csv(path)
    )
    tokens = [t for t in null_tokens]
    cols = []
    for c in raw.columns:
        v = F.trim(q(c))
        cols.append(F.when((v == "") | v.isin(tokens) if tokens else (v == ""), F.lit(None)).otherwise(q(c)).alias(c))
    text = raw.select(*cols)
    if as_string:
        return text
    if schema_types is None:
        schema_types = infer_types(text, d["decimal"])
    out = []
    for c in text.columns:
        t = schema_types.get(c, "string")
        if t == "string":
            out.append(q(c))
        else:
            out.append(_normalized(F.trim(q(c)), d["decimal"]).cast(t).alias(c))
    return nan_to_null(text.select(*out))


def normalize_missing(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Text columns of any DataFrame with empty fields and missing-value words
    (blanks around them aside) as NULL; NaN as NULL in float columns."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            v = F.trim(q(f.name))
            cols.append(F.when((v == "") | v.isin(list(tokens)), F.lit(None)).otherwise(q(f.name)).alias(f.name))
        else:
            cols.append(q(f.name))
    return nan_to_null(df.select(*cols))


def infer_numeric(df: DataFrame, decimal: str = ".") -> DataFrame:
    """Text columns whose non-null values all read as numbers become bigint or
    double (one aggregate pass for all); the others stay as they are."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    types = infer_types(df.select(*[q(c) for c in text]), decimal)
    cols = [
        _normalized(F.trim(q(c)), decimal).cast(types[c]).alias(c) if types.get(c, "string") != "string" else q(c)
        for c in df.columns
    ]
    return nan_to_null(df.select(*cols))


def infer_types(text: DataFrame, decimal: str = ".") -> dict[str, str]:
    """One aggregate pass: 'bigint' if every non-null value is an integer,
    'double' if every one is a number, else 'string' (all-or-nothing per
    column).  An all-null column stays text."""
    aggs = []
    for i, c in enumerate(text.columns):
        v = _normalized(F.trim(q(c)), decimal)
        aggs += [
            F.count(q(c)).alias(f"n{i}"),
            F.count_if(q(c).isNotNull() & v.try_cast("bigint").isNull()).alias(f"l{i}"),
            F.count_if(q(c).isNotNull() & v.try_cast("double").isNull()).alias(f"d{i}"),
        ]
    if not aggs:
        return {}
    row = one_row(text.agg(*aggs))
    types = {}
    for i, c in enumerate(text.columns):
        if row[f"n{i}"] == 0:
            types[c] = "string"
        elif row[f"l{i}"] == 0:
            types[c] = "bigint"
        elif row[f"d{i}"] == 0:
            types[c] = "double"
        else:
            types[c] = "string"
    return types


def write_delimited(df: DataFrame, path: str, single_file: bool = False, sep: str = ",", mode: str = "overwrite") -> None:
    """CSV with a header, UTF-8, NULL as an empty field.  With ``single_file``
    one task writes -- for small results; the work before stays distributed."""
    out = df.repartition(1) if single_file else df
    out.write.mode(mode).option("header", True).option("sep", sep).option("encoding", "UTF-8").csv(path)
