"""New files only: a file stream that ends when it has seen what is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def process_new(spark: SparkSession, path: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, per_batch: int = 1000) -> None:
    """Apply ``work`` to the Parquet files below ``path`` that no earlier call has seen and append to ``out``.

    ``checkpoint`` lies in a folder that all executors share. The sink's own log names
    the files of each batch, so a batch that is run again after a failure isn't doubled.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)
    query = work(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def missing_from(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``wanted`` that ``done`` lacks."""
    return wanted.join(done.select(key), key, "left_anti")
