"""Continuous forms: expert verdicts as they are logged, image files as they appear, windowed activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from driftcurve.sources.tables import name_metadata, parse_label_log


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (row_index, label) from log files as they arrive; blank and malformed lines are skipped."""
    return parse_label_log(spark.readStream.text(folder)).select("iteration", "ts", "row_index", "label")


def append_verdicts(spark: SparkSession, folder: str, table: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append verdicts to a Parquet table, exactly once; `once` takes what is there and ends."""
    writer = verdicts(spark, folder).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table)
    return (writer.trigger(availableNow=True) if once else writer).start()


def new_sources(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Of a stream of (path, modificationTime) the first file of each source id; ids are remembered for as long as files may arrive late."""
    named = files.withColumns(name_metadata(F.col("path"))).withWatermark("modificationTime", delay)
    return named.dropDuplicatesWithinWatermark(["source_id"])


def activity(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count, mean and lowest value of (id, ts, mag) in windows of time; state for a window goes when it can no longer change."""
    df = events.withWatermark("ts", late)
    return df.groupBy(F.window("ts", width), "id").agg(F.count("*").alias("n"), F.avg("mag").alias("mean"), F.min("mag").alias("lowest")).select("window.start", "window.end", "id", "n", "mean", "lowest")
