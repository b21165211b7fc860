"""Every registered query and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftcurve.functions import families as fam
from driftcurve.operators import series as ser
from driftcurve.plans import selection_queries, series_queries
from driftcurve.sources.curves import curves


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten series that dip deepest: cleaned, normalised, aggregated and ranked with one shuffle."""
    s = ser.with_norm(ser.clean_outlier(curves(spark, sf_dir), k=3.0))
    whole = fam.apply(s, fam.main_stats("mag"), fam.main_stats("norm", entropy=False), fam.shape("norm", times="mjd"))
    return series_queries.rounded(whole.orderBy(F.col("norm_n_below_3sigma").desc(), F.col("norm_min"), "id").limit(10))


def queries() -> dict:
    return {**series_queries.QUERIES, **selection_queries.QUERIES}


def oracle_sql() -> dict:
    return {**series_queries.SQL, **selection_queries.SQL}
