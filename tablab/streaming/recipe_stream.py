"""Apply a fitted recipe to a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tablab.plans.recipe import Recipe
from tablab.sources.tables import nan_to_null


def read_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, **options) -> DataFrame:
    """A streaming DataFrame over files in ``path`` (schema given: streams do
    not infer), with the same NaN -> NULL rule as batch tables."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in options.items():
        r = r.option(k, v)
    return nan_to_null(r.load(path))


def apply_recipe_stream(recipe: Recipe, stream: DataFrame) -> DataFrame:
    """The fitted recipe's apply on a streaming DataFrame.  Steps that need
    all rows at once (drop_duplicates) are rejected: a stream has no end."""
    if any(s.op == "drop_duplicates" for s in recipe.steps):
        raise ValueError("drop_duplicates needs the whole table; use dropDuplicatesWithinWatermark on streams")
    return recipe.apply(stream)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", trigger_once: bool = False) -> StreamingQuery:
    """Append the stream to files under ``path``.  ``checkpoint`` is a shared
    folder that holds the progress: a restart with the same folder reads every
    input file once over all runs."""
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
