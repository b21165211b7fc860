"""Sequence channels and matrices for sequence models."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from driftcurve.functions.families import ordered, series_window

FLAT = 1e-8
TIME_SCALE = 10.0
ZERO_POINT = 27.5


def centred_scale(x: str) -> Column:
    """(x - mean) / population deviation; only centred where that is next to nothing."""
    mu, sd = F.avg(x).over(series_window()), F.stddev_pop(x).over(series_window())
    return F.when(sd > FLAT, F.try_divide(F.col(x) - mu, sd)).otherwise(F.col(x) - mu)


def smooth3(x: str) -> Column:
    """Mean of a point and its neighbours; an end repeats itself for the one it lacks."""
    c = F.col(x)
    return (F.coalesce(F.lag(c).over(ordered()), c) + c + F.coalesce(F.lead(c).over(ordered()), c)) / 3


def flux() -> Column:
    return F.pow(F.lit(10.0), -0.4 * (F.col("mag") - ZERO_POINT))


def _velocity() -> Column:
    dt = F.col("mjd") - F.lag("mjd").over(ordered())
    dt = F.when(F.abs(dt) < 1e-10, F.lit(1e-10)).otherwise(dt)
    return F.coalesce((F.col("mag") - F.lag("mag").over(ordered())) / dt, F.lit(0.0))


def _local_std(series: DataFrame) -> DataFrame:
    series = series.withColumn("__m", smooth3("mag"))
    series = series.withColumn("__q", (F.col("mag") - F.col("__m")) * (F.col("mag") - F.col("__m")))
    return series.withColumn("local_std", F.sqrt(F.greatest(smooth3("__q"), F.lit(0.0)))).drop("__m", "__q")


CHANNELS = {
    "norm": lambda s: s.withColumn("norm", centred_scale("mag")),
    "vel": lambda s: s.withColumn("vel", _velocity()),
    "flux": lambda s: s.withColumn("flux", flux()),
    "flux_err": lambda s: s.withColumn("flux_err", flux() * F.col("magerr") * (0.4 * math.log(10.0))),
    "snr": lambda s: s.withColumn("snr", 1 / F.greatest(F.col("magerr"), F.lit(1e-6))),
    "t_since_peak": lambda s: s.withColumn("t_since_peak", F.col("mjd") - F.min_by("mjd", F.struct("mag", "pos")).over(series_window())),
    "local_std": _local_std,
    "detrended": lambda s: s.withColumn("detrended", F.col("mag") - smooth3("mag")),
}


def with_channels(series: DataFrame, names: list[str]) -> DataFrame:
    """Add derived channels; a name that is neither one nor a column is an error."""
    for n in names:
        if n in CHANNELS:
            series = CHANNELS[n](series)
        elif n not in series.columns:
            raise ValueError(f"unknown channel {n!r}; known: {sorted(CHANNELS)}")
    return series


def preprocessed(series: DataFrame, columns: tuple[str, ...] = ("mjd", "mag", "magerr")) -> DataFrame:
    """The first column as scaled time steps (0 at first), the others standardised within their series."""
    steps = F.coalesce(F.col(columns[0]) - F.lag(columns[0]).over(ordered()), F.lit(0.0)) / TIME_SCALE
    return series.withColumns({columns[0]: steps} | {c: centred_scale(c) for c in columns[1:]})


def points(columns: tuple[str, ...], kind: str = "float") -> Column:
    """The aggregate `sequence`: an array of points in order, each an array of the columns' values."""
    point = F.struct("pos", F.array(*(F.col(c).cast(kind) for c in columns)).alias("v"))
    return F.array_sort(F.collect_list(point)).getField("v").alias("sequence")


def stacked(series: DataFrame, columns: tuple[str, ...], kind: str = "float") -> DataFrame:
    """(id, sequence) of each series."""
    return series.groupBy("id").agg(points(columns, kind))


def padded(sequences: DataFrame, width: int, to: int | None = None) -> DataFrame:
    """Sequences filled with zero points to a common length (the longest one's, found first, unless given); adds `length`."""
    longest = to if to is not None else sequences.agg(F.max(F.size("sequence"))).first()[0] or 0
    kind = sequences.schema["sequence"].dataType.elementType
    zero = F.array(*[F.lit(0.0)] * width).cast(kind)
    fill = F.array_repeat(zero, F.greatest(F.lit(longest) - F.size("sequence"), F.lit(0)))
    return sequences.withColumn("length", F.size("sequence").cast("bigint")).withColumn("sequence", F.concat("sequence", fill))


def scrubbed(x: Column) -> Column:
    """NaN and null as 0, infinities as a million with their sign."""
    inf = float("inf")
    return F.when(x.isNull() | F.isnan(x), 0.0).when(x == inf, 1e6).when(x == -inf, -1e6).otherwise(x)
