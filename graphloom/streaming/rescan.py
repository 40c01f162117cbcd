"""Rescan on change: a file stream feeds the front end, each batch replaces its files' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """A stream of (file, source_code) for new files below a folder."""
    rows = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("source_code"))


def rescan(files: DataFrame, analyse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Start the query: every batch is analysed as a whole and written under its batch number.

    A batch that is repeated after a failure overwrites its own folder, so nothing counts twice.
    """

    def each(batch: DataFrame, number: int) -> None:
        analyse(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(results: DataFrame) -> DataFrame:
    """Of each file the rows of its last batch."""
    last = results.groupBy("file").agg(F.max("batch").alias("batch"))
    return results.join(last, ["file", "batch"], "left_semi")
