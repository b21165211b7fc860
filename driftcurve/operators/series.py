"""Series in long form: building, normalising, steps, outliers, back to arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftcurve.functions.families import ordered, series_window

#: Modified Julian Date of 1970-01-01, and microseconds of a day.
MJD_1970, DAY_US = 40587.0, 86_400_000_000.0


def to_mjd(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / DAY_US + MJD_1970


def from_mjd(mjd: Column) -> Column:
    """A UTC timestamp, fractions of a day included."""
    return F.timestamp_micros(F.round((mjd - MJD_1970) * DAY_US).cast("bigint"))


def explode_series(nested: DataFrame, columns: tuple[str, ...] = ("mjd", "mag", "magerr")) -> DataFrame:
    """Array columns of equal length as one row per point, with `pos` from 0. A series without points keeps one row of nulls."""
    own = [c for c in columns if c in nested.columns]
    rest = [c for c in nested.columns if c not in own]
    zipped = nested.select(*rest, F.posexplode_outer(F.arrays_zip(*own)).alias("pos", "__p"))
    return zipped.select(*rest, "pos", *(F.col("__p")[c].alias(c) for c in own))


def implode_series(series: DataFrame, columns: tuple[str, ...] = ("mjd", "mag", "magerr"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Back to one row per id with arrays in the order of `pos`; `keep` are columns that do not vary within an id."""
    own = [c for c in columns if c in series.columns]
    packed = series.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", *own)))).alias("__p"), *(F.first(c).alias(c) for c in keep))
    return packed.select("id", *keep, *(F.col("__p").getField(c).alias(c) for c in own))


def with_norm(series: DataFrame, zero: str = "null") -> DataFrame:
    """Add `norm` = (mag - median mag) / median magerr per series.

    Where the median error is 0: "null" leaves norm undefined, "raise" fails, "centre" subtracts the median only.
    """
    mid, err = F.median("mag").over(series_window()), F.median("magerr").over(series_window())
    if zero == "raise":
        err = F.when(F.abs(err) < 1e-12, F.raise_error(F.lit("median magerr is 0"))).otherwise(err)
    ratio = F.try_divide(F.col("mag") - mid, err)
    return series.withColumn("norm", F.when(err == 0, F.col("mag") - mid).otherwise(ratio) if zero == "centre" else ratio)


def with_steps(series: DataFrame) -> DataFrame:
    """Add `mjd_diff` and `velocity` = step of mag / step of mjd; null at the first point, velocity also where time stands still."""
    dt = F.col("mjd") - F.lag("mjd").over(ordered())
    return series.withColumns({"mjd_diff": dt, "velocity": F.try_divide(F.col("mag") - F.lag("mag").over(ordered()), dt)})


def rescaled(x: str, how: str) -> Column:
    """A column scaled within its series: minmax (0 if constant) or zscore (null if it has no deviation)."""
    c = F.col(x)
    if how == "minmax":
        low, high = F.min(c).over(series_window()), F.max(c).over(series_window())
        return F.when(high == low, F.lit(0.0)).otherwise(F.try_divide(c - low, high - low))
    if how == "zscore":
        return F.try_divide(c - F.avg(c).over(series_window()), F.stddev_samp(c).over(series_window()))
    raise ValueError(how)


def with_outliers(series: DataFrame, k: float, column: str = "mag") -> DataFrame:
    """Add `__out` (strictly outside the quartiles by k interquartile ranges) and `__outs`, their number in the series."""
    q1, q3 = F.percentile(column, F.lit(0.25)).over(series_window()), F.percentile(column, F.lit(0.75)).over(series_window())
    out = (F.col(column) < q1 - k * (q3 - q1)) | (F.col(column) > q3 + k * (q3 - q1))
    series = series.withColumn("__out", F.coalesce(out, F.lit(False)))
    return series.withColumn("__outs", F.sum(F.col("__out").cast("int")).over(series_window()))


def clean_outlier(series: DataFrame, k: float = 40.0, column: str = "mag") -> DataFrame:
    """Replace a series' only outlier by its neighbours' mean (at an end by the one neighbour) and add `had_od`.

    Series with no or several outliers stay as they are.
    """
    series = with_outliers(series, k, column)
    before, after = F.lag(column).over(ordered()), F.lead(column).over(ordered())
    between = F.coalesce((before + after) / 2, before, after, F.col(column))
    series = series.withColumn("__clean", F.when((F.col("__outs") == 1) & F.col("__out"), between).otherwise(F.col(column)))
    return series.withColumn("had_od", F.col("__outs") == 1).withColumn(column, F.col("__clean")).drop("__clean", "__out", "__outs")


def drop_outlier(series: DataFrame, k: float = 40.0) -> DataFrame:
    """Leave a series' only outlier out."""
    series = with_outliers(series, k)
    return series.where(~((F.col("__outs") == 1) & F.col("__out"))).drop("__out", "__outs")
