"""Reproducible random orders, and ranks in them, without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def hashed(seed: int, *keys: str) -> Column:
    """A reproducible shuffle: order by this instead of drawing at random."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def hash_ranked(df: DataFrame, seed: int, keys: tuple[str, ...], strata: Column | None = None) -> DataFrame:
    """Add `__rank` (from 1, in hashed order) and `__n`, per stratum, without sorting a stratum in one task.

    Rows fall into 4096 buckets by the start of their hash. Buckets are counted, their offsets summed over
    at most 4096 rows a stratum, and rows ranked within a bucket: together that is their rank in all.
    """
    df = df.withColumns({"__s": strata if strata is not None else F.lit(0), "__h": hashed(seed, *keys)}).withColumn("__b", F.substring("__h", 1, 3))
    counts = df.groupBy(F.col("__s").alias("__cs"), F.col("__b").alias("__cb")).agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy("__cs").orderBy("__cb").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__cs", "__cb", before.alias("__before"), F.sum("__c").over(W.partitionBy("__cs")).alias("__n"))
    joined = df.join(counts, F.col("__s").eqNullSafe(F.col("__cs")) & (F.col("__b") == F.col("__cb")))
    within = F.row_number().over(W.partitionBy("__s", "__b").orderBy("__h", *keys))
    return joined.withColumn("__rank", F.col("__before") + within).drop("__s", "__h", "__b", "__cs", "__cb", "__before")


BUCKETS = 256


def placed(df: DataFrame, descending: str, tie: str, per_bucket: int = 32) -> DataFrame:
    """Add `place`, from 1, by falling `descending` and rising `tie` (an integer), without sorting all rows in one task.

    Edges between buckets are rows of a sample (some BUCKETS x `per_bucket` rows, those with low hashes), so buckets
    hold about as many rows each however the values are spread, ties of the first column included. A row finds
    its bucket by halving. Buckets are counted, the counts summed in order, and rows numbered within a bucket.
    Nulls come last.
    """
    value, last = F.coalesce(-F.col(descending).cast("double"), F.lit(float("inf"))), F.col(tie).cast("bigint")
    key = F.struct(value.alias("v"), last.alias("t"))
    share = min(1.0, BUCKETS * per_bucket / max(1, df.count()))
    drawn = df.where(F.pmod(F.xxhash64(descending, tie), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select(value.alias("v"), last.alias("t")).where("t IS NOT NULL")
    rows = sorted((r["v"], r["t"]) for r in drawn.collect())
    edges = [rows[len(rows) * k // BUCKETS] for k in range(1, BUCKETS)] if rows else [(0.0, 0)] * (BUCKETS - 1)
    table = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(t).cast("bigint").alias("t")) for v, t in edges))
    df = df.withColumn("__b", F.lit(0))
    step = BUCKETS // 2
    while step:
        df = df.withColumn("__b", F.col("__b") + F.when(key >= F.get(table, F.col("__b") + step - 1), step).otherwise(0))
        step //= 2
    counts = df.groupBy(F.col("__b").alias("__cb")).agg(F.count("*").alias("__c"))
    before = counts.select("__cb", F.coalesce(F.sum("__c").over(W.orderBy("__cb").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.row_number().over(W.partitionBy("__b").orderBy(value, last))
    return df.join(before, F.col("__b") == F.col("__cb")).withColumn("place", F.col("__before") + within).drop("__b", "__cb", "__before")
