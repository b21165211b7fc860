"""Series from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from driftcurve.operators.series import to_mjd


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    """Partitions for steps that cost much time a byte: four for each core, so that the last wave of tasks is a small part of all."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def curves(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """`events` as series in long form: one per user, in the order of time.

    All later windows and aggregates by id reuse the shuffle that numbers the points. Adaptive execution merges its
    partitions by their bytes, about as many as there are cores; with `spread` it leaves them as they are.
    """
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    order = W.partitionBy("id").orderBy("mjd", "event_id")
    points = events.select(
        F.col("user_id").alias("id"), "event_id", to_mjd("ts").alias("mjd"), F.col("value").alias("mag"), (F.lit(0.01) + 0.001 * (F.col("event_id") % 97)).alias("magerr"), (F.col("user_id") % 20 == 0).cast("int").alias("class")
    )
    if spread:
        points = points.repartition(parts(spark), "id")
    return points.withColumn("pos", (F.row_number().over(order) - 1).cast("bigint"))
