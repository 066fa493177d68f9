"""Token counts of flat, unindexed token files by a separator scan.

The files hold nothing but fixed-width ids; an end-of-document id closes each document.  Blocks of equal size are read
by independent tasks; in each a vectorised search finds the separators.  A document may begin in one block and end many
blocks later: per block only (tokens before the first separator, separators, tokens after the last) matter for that,
and a running sum over the block summaries of a file -- a few numbers a block -- stitches them together.

Defined results: documents are numbered from 0 in file order; tokens after a file's last separator are a document
without an end (``closed`` false), no tokens there are none; two separators in a row hold an empty document; an empty
file has no document.  A file that is not a whole number of ids is an error.  For tables: a null text is an empty one
(0 tokens); rows with null or repeated ids each keep a row and their own count; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablab.llm.bpe import encoder_of
from tablab.llm.common import materialise, ref
from tablab.llm.storage import TASK_BYTES, PartFile, RangeReader, tasks_for
from tablab.session import scratch_path

BLOCK_BYTES = 8 << 20


def write_token_files(docs: DataFrame, content: bytes, eod: int, folder: str, id_col: str = "doc_id",
                      text_col: str = "text", width: int = 2) -> DataFrame:
    """Encode all texts (special tokens as ordinary text, so that no separator hides in one) to flat little-endian
    files of ``width``-byte ids, one file per task, and return the manifest: file, n_bytes, doc (number in the file)
    and the id column, one row per document, materialised."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(content)
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, n = encoder_of(vocabulary.value, specials=False), None, 0
        if max(encoder.v.width, eod + 1) > 1 << (8 * width):
            raise ValueError("ids do not fit the width")
        end = np.array([eod], kind).tobytes()
        for batch in batches:
            part = part or PartFile(folder, ".tokens")
            for ids in encoder.encode_column(batch.column(1)):
                part.write(np.frombuffer(ids, "<u4").astype(kind).tobytes() + end)
            places = pa.array(range(n, n + batch.num_rows), pa.int64())
            n += batch.num_rows
            names = pa.array([part.uri] * batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([names, places, batch.column(0)], names=["file", "doc", id_col])
        if part:
            part.close()

    rows = docs.select(ref(id_col).alias(id_col), ref(text_col).alias("text"))
    return materialise(rows.mapInArrow(run, f"file string, doc long, `{id_col}` {docs.schema[id_col].dataType.simpleString()}"), "manifest")


def file_blocks(spark: SparkSession, files: list[str] | DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, offset, length) of all blocks; sizes come from the files themselves."""
    names = files if isinstance(files, DataFrame) else spark.createDataFrame([(f,) for f in files], "file string")

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tablab.llm.storage import filesystem

        for batch in batches:
            found = []
            for uri in batch.column(0).to_pylist():
                system, path = filesystem(uri)
                found.append(system.get_file_info(path).size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["file", "n_bytes"])

    known = names.mapInArrow(sizes, "file string, n_bytes long").where("n_bytes > 0")
    step = F.lit(block_bytes)
    starts = F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, step.cast("long"))
    blocks = known.select("file", "n_bytes", F.posexplode(starts).alias("block", "offset"))
    return blocks.select("file", "block", "offset", F.least(step, F.col("n_bytes") - F.col("offset")).alias("length"))


def scan_blocks(blocks: DataFrame, eod: int, width: int = 2) -> DataFrame:
    """Per block: tokens, separators, tokens before the first (``head``) and after the last (``tail``), and the lengths
    of the documents that lie wholly between two separators of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader()
        for batch in batches:
            for row in batch.to_pylist():
                if row["length"] % width:
                    raise ValueError(f"{row['file']} is not a whole number of ids")
                ids = np.frombuffer(reader.read(row["file"], row["offset"], row["length"]), f"<u{width}")
                ends = np.flatnonzero(ids == eod)
                head, tail = (int(ends[0]), len(ids) - int(ends[-1]) - 1) if len(ends) else (len(ids), len(ids))
                inner = pa.array([np.diff(ends) - 1], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["file"]]), *(pa.array([x], pa.int64()) for x in (row["block"], len(ends), head, tail)), inner],
                    names=["file", "block", "ends", "head", "tail", "inner"],
                )
        reader.close()

    return blocks.mapInArrow(run, "file string, block long, ends long, head long, tail long, inner array<bigint>")


def count_tokens(spark: SparkSession, files: list[str] | DataFrame, eod: int, width: int = 2,
                 block_bytes: int = BLOCK_BYTES, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(file, doc, n_tokens, closed) of every document of the files, scanned by one task for about ``task_bytes``."""
    if block_bytes % width:
        raise ValueError("a block must hold a whole number of ids")
    blocks = materialise(file_blocks(spark, files, block_bytes), "blocks")
    tasks = tasks_for(blocks.agg(F.sum("length")).first()[0], task_bytes)
    scanned = materialise(scan_blocks(blocks.repartition(tasks, "file", "block"), eod, width), "scanned")  # tasks of equal blocks, not of files
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = scanned.select(
        "file", "block", "ends", "head", "tail",
        F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("doc"),  # documents closed in earlier blocks
        F.coalesce(F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(before), F.lit(0)).alias("run"),
        F.row_number().over(Window.partitionBy("file").orderBy(F.desc("block"))).alias("from_end"),
    )
    # a run: the block after a separator's block up to the next block with a separator; open tokens add up in it
    in_run = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.lag(F.when(F.col("ends") > 0, F.col("tail"))).over(order)
    marked = marked.withColumn("entry", last)
    carried = F.coalesce(F.sum(F.when(F.col("ends") == 0, F.col("tail"))).over(in_run), F.lit(0)) + F.coalesce(
        F.max("entry").over(Window.partitionBy("file", "run")), F.lit(0)
    )
    stitched = marked.withColumn("carried", carried)
    closing = stitched.where("ends > 0").select("file", "doc", (F.col("carried") + F.col("head")).alias("n_tokens"), F.lit(True).alias("closed"))
    left = F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("carried") + F.col("tail"))
    opened = stitched.where("from_end = 1").select("file", (F.col("doc") + F.col("ends")).alias("doc"), left.alias("n_tokens"), F.lit(False).alias("closed"))
    inner = scanned.where("size(inner) > 0").join(stitched.select("file", "block", "doc"), ["file", "block"]).select(
        "file", F.posexplode("inner").alias("k", "n_tokens"), "doc"
    ).select("file", (F.col("doc") + F.col("k") + 1).alias("doc"), "n_tokens", F.lit(True).alias("closed"))
    return closing.union(inner).union(opened.where("n_tokens > 0"))


def documents_token_counts(docs: DataFrame, content: bytes, eod: int, id_col: str = "doc_id", text_col: str = "text",
                           width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the texts to flat token files, then count every document's tokens by scanning those files alone; the
    manifest only gives the counts their ids back."""
    spark = docs.sparkSession
    manifest = write_token_files(docs, content, eod, scratch_path(spark, "tokens"), id_col, text_col, width)
    counts = count_tokens(spark, manifest.select("file").distinct(), eod, width, block_bytes)
    return manifest.join(counts, ["file", "doc"]).select(ref(id_col), "n_tokens")
