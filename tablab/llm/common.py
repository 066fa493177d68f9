"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablab.session import scratch_path

#: The word class of every operator here: a maximal run of anything but ASCII white space.
WORD_SPACE = " \t\n\x0b\x0c\r"


#: Files of a scratch table per core of the session at most.  Further partitions share a task and a file: many small ones
#: cost more to open, list and commit than to read.
FILES_PER_CORE = 8


def write_scratch(df: DataFrame, name: str) -> str:
    """Write ``df`` to the shared scratch folder; its path."""
    path = scratch_path(df.sparkSession, name)
    df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism).write.parquet(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the lineage, so work is done once and a
    lost executor costs one re-read, not a re-computation."""
    return df.sparkSession.read.schema(df.schema).parquet(write_scratch(df, name))


def temp_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, whatever extra columns the caller brings."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"__{stem}_{uuid.uuid4().hex[:8]}"
    return name


def ref(name: str) -> Column:
    """Column by its exact name (dots and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes.  ``bytes.split()`` breaks on exactly 0x20 and 0x09-0x0D."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def as_signed(a: np.ndarray) -> np.ndarray:
    """uint64 bit patterns as int64, the only 64-bit integer Spark has."""
    return a.astype(np.uint64, copy=False).view(np.int64)


#: A key with over one in so many rows is hot; there are fewer hot keys than this, whatever the table.
HOT_KEYS = 1000


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, which has one row per key and in ``weight`` (at least 1) the number of
    ``rows`` with that key.  The facts of hot keys, fewer than ``HOT_KEYS`` by counting, are broadcast, so a key with a
    third of all rows stays where its rows are; all other keys meet by shuffle, none with over a thousandth of the rows.
    Both frames are read more than once: pass written tables."""
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = ref(weight) * HOT_KEYS > total
    heavy, light = facts.where(hot), facts.where(~hot)
    direct = rows.join(F.broadcast(heavy), keys)
    return direct.unionByName(rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys))


def release(spark) -> None:
    """Let Spark delete the shuffle files of finished steps now: it does so once the driver has collected the objects
    that refer to them, which a small driver heap may not do for a long time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that finished fits have freed back to the system: the driver keeps running for hours after them."""
    gc.collect()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
