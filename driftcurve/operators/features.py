"""All features of a series table in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from driftcurve.functions import families as fam
from driftcurve.functions.filters import WAVELETS
from driftcurve.operators import series as ser, wavelets as wav


def extract_all(
    series: DataFrame, od_k: float = 40.0, od_column: str = "mag", wavelets: tuple[str, ...] = WAVELETS, levels: int = 5, interpolate: bool = True, points: int = wav.GRID,
    split_by: str | None = "mag", additional: bool = True, argmin: bool = True, argmax: bool = False, wavelets_on_cleaned: bool = False, float32: bool = True, zero: str = "centre",
) -> DataFrame:
    """One row per series of (id, class, pos, mjd, mag, magerr): 494 columns with the defaults.

    Outliers are cleaned first (not at all with od_k 0); the wavelets see the series as it came unless
    `wavelets_on_cleaned`. `split_by` is the column whose extremum splits a series, None for no such
    statistics. All windows and the wide aggregate share the shuffle by id; the arrays for the wavelet
    kernel are collected in the same aggregate, so the kernel is a map over its result.
    """
    keep = [F.first("class").alias("class")] if "class" in series.columns else []
    raw = ser.with_norm(series, zero).withColumnRenamed("norm", "__raw_norm")
    clean = ser.clean_outlier(raw, od_k, od_column) if od_k else raw.withColumn("had_od", F.lit(False))
    own = ser.with_steps(ser.with_norm(clean, zero))
    parts = [fam.main_stats(x, entropy=x != "norm") for x in ("mag", "magerr", "norm", "velocity", "mjd_diff")]
    parts += [fam.shape("mag"), fam.shape("norm", times="mjd"), fam.shape("velocity", "vel")]
    if split_by:
        parts += [fam.split_stats(x, side, which, split_by, steps=x == "velocity", additional=additional) for which, on in (("argmin", argmin), ("argmax", argmax)) if on for x in ("mag", "norm", "velocity") for side in ("to", "from")]
    meta = [*keep, F.max("had_od").alias("had_od"), F.count("mag").alias("npoints"), ser.from_mjd(F.max("mjd")).alias("ts")]
    if wavelets:
        point = F.struct("pos", "mjd", F.col("norm" if wavelets_on_cleaned else "__raw_norm").alias("v"))
        meta.append(F.array_sort(F.collect_list(point)).alias("__points"))
    out = fam.with_fractions(fam.apply(own, *parts, fam.Family([], meta)))
    if wavelets:
        keys = tuple(c for c in out.columns if c != "__points")
        arrays = out.withColumns({"__mjd": F.col("__points.mjd"), "__norm": F.col("__points.v")})
        out = wav.wavelet_features(arrays, "__norm", "__mjd" if interpolate else None, wavelets, levels, "norm", points, keys)
    if float32:
        out = out.select(*(F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))
    return out
