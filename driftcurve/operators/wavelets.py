"""Discrete wavelet transforms and their statistics.

For signals of one length a transform is a linear map, so a batch of them is a matrix product: the
kernel builds one matrix per wavelet and level and applies it to all signals of an Arrow batch. A
single level can also be had as a join with the filter's taps, without Python.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftcurve.functions.filters import WAVELETS, high_pass, low_pass, usable_levels
from driftcurve.session import with_code

GRID, SHORTEST, EPSILON = 64, 8, 1e-10
GLOBALS = ("total_energy", "detail_ratio", "max_detail", "entropy", "detail_approx_ratio", "dominant_level")
PER_LEVEL = ("energy", "rel_energy", "mean", "std", "skewness", "kurtosis", "mad", "frac_above_2std")


def feature_names(wavelets: tuple[str, ...] = WAVELETS, levels: int = 5, prefix: str = "norm") -> list[str]:
    start = f"{prefix}_wv" if prefix else "wv"
    return [f"{start}_{w}_{k}" for w in wavelets for k in (*GLOBALS, *(f"d{i}_{s}" for i in range(1, levels + 1) for s in PER_LEVEL))]


def mirrored(i: np.ndarray, n: int) -> np.ndarray:
    """Indices beyond the ends, reflected so that the end point repeats."""
    i = np.mod(i, 2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


@lru_cache(maxsize=512)
def level_maps(n: int, wavelet: str) -> tuple[np.ndarray, np.ndarray]:
    """Matrices (out, n) from a signal to its approximation and details."""
    low, high = np.array(low_pass(wavelet)), np.array(high_pass(wavelet))
    taps, out = len(low), (n + len(low) - 1) // 2
    maps = np.zeros((2, out, n))
    rows = np.arange(out)
    for j in range(taps):
        at = mirrored(2 * rows + 2 - taps + j, n)
        np.add.at(maps[0], (rows, at), low[taps - 1 - j])
        np.add.at(maps[1], (rows, at), high[taps - 1 - j])
    return maps[0], maps[1]


def decompose(signals: np.ndarray, wavelet: str, max_level: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Approximations and details, coarsest level first, of signals (rows) of one length."""
    details = []
    for _ in range(max(1, min(max_level, usable_levels(signals.shape[1], wavelet)))):
        low, high = level_maps(signals.shape[1], wavelet)
        details.append(signals @ high.T)
        signals = signals @ low.T
    return signals, details[::-1]


def level_stats(d: np.ndarray, energy: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
    zero = np.zeros(len(d))
    if d.shape[1] == 1:
        return [energy, energy / (total + EPSILON), d[:, 0], zero, zero, zero, zero, zero]
    mean = d.mean(axis=1)
    dev = d - mean[:, None]
    var = (dev**2).mean(axis=1)
    std = np.sqrt(var)
    with np.errstate(divide="ignore", invalid="ignore"):
        skew = np.where(std > EPSILON, (dev**3).mean(axis=1) / std**3, 0.0)
        kurt = np.where(var > EPSILON, (dev**4).mean(axis=1) / var**2 - 3, 0.0)
    mad = np.abs(d - np.median(d, axis=1)[:, None]).mean(axis=1)
    above = np.where(std > EPSILON, (np.abs(d) > 2 * std[:, None]).mean(axis=1), 0.0)
    return [energy, energy / (total + EPSILON), mean, std, skew, kurt, mad, above]


def statistics(signals: np.ndarray, wavelets: tuple[str, ...] = WAVELETS, levels: int = 5) -> np.ndarray:
    """All features of signals (rows) of one length, in the order of feature_names; levels that a length lacks are 0."""
    out = []
    for w in wavelets:
        approx, details = decompose(signals, w, levels)
        rough = (approx**2).sum(axis=1)
        energy = np.stack([(d**2).sum(axis=1) for d in details])
        detail = energy.sum(axis=0)
        total = rough + detail
        p = energy / (total + EPSILON)
        entropy = -np.where(p > EPSILON, p * np.log(np.maximum(p, 0) + EPSILON), 0.0).sum(axis=0)
        dominant = np.where(energy.max(axis=0) > 0, energy.argmax(axis=0) + 1.0, 0.0)
        out += [total, detail / (total + EPSILON), np.max([np.abs(d).max(axis=1) for d in details], axis=0), entropy, detail / (rough + EPSILON), dominant]
        for k in range(levels):
            out += level_stats(details[k], energy[k], total) if k < len(details) else [np.zeros(len(signals))] * len(PER_LEVEL)
    return np.stack(out, axis=1)


def regular(values: np.ndarray, times: np.ndarray | None, points: int = GRID) -> np.ndarray:
    """A signal on an even grid over its time span, linear between its points; as it is without times or a span."""
    values = np.where(np.isfinite(values), values, 0.0)
    if times is None or len(times) < 2:
        return values
    times = np.where(np.isfinite(times), times, 0.0)
    low, high = times.min(), times.max()
    if high <= low:
        return values
    return np.interp(low + np.arange(points) * ((high - low) / (points - 1)), times, values)


def wavelet_features(nested: DataFrame, value: str = "norm", time: str | None = "mjd", wavelets: tuple[str, ...] = WAVELETS, levels: int = 5, prefix: str = "norm", points: int = GRID, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """`keys` and the wavelet features of an array column. Series of under SHORTEST points are all 0, as are null ones.

    Only the two arrays go to Python, and the kernel is not run where none of its columns is used.
    """
    for w in wavelets:
        low_pass(w)
    names = feature_names(wavelets, levels, prefix)

    @F.arrow_udf("array<double>")
    def features(values: pa.Array, times: pa.Array) -> pa.Array:
        got = np.zeros((len(values), len(names)))
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i in range(len(values)):
            v, t = values[i], times[i]
            if v.is_valid and len(v) >= SHORTEST:
                array = lambda x: x.values.to_numpy(zero_copy_only=False).astype(float)
                s = regular(array(v), array(t) if t.is_valid else None, points)
                by_length.setdefault(len(s), []).append((i, s))
        for rows in by_length.values():
            got[[i for i, _ in rows]] = statistics(np.stack([s for _, s in rows]), wavelets, levels)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, got.size + 1, len(names)), pa.int32()), pa.array(got.ravel()))

    t = F.col(time).cast("array<double>") if time else F.lit(None).cast("array<double>")
    made = with_code(nested).select(*keys, features(F.col(value).cast("array<double>"), t).alias("__w"))
    return made.select(*keys, *(F.get("__w", F.lit(k)).alias(n) for k, n in enumerate(names)))


def dwt_levels(points: DataFrame, wavelets: tuple[str, ...] = WAVELETS, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One level of (keys, pos, x) in long form by several wavelets as (keys, wavelet, k, approx, detail), by a join with the filters' taps.

    Each point meets the few outputs of each filter that it contributes to; the taps are literals of the plan.
    The points are read and shuffled once, by their series: the sums by output reuse that.
    """
    own = points.withColumn("__n", F.count("*").over(W.partitionBy(*keys)))
    one = lambda w: F.struct(F.lit(w).alias("wavelet"), F.lit(len(low_pass(w))).alias("taps"), *(F.array(*map(F.lit, reversed(f(w)))).alias(k) for k, f in (("low", low_pass), ("high", high_pass))))
    own = own.withColumn("__f", F.explode(F.array(*map(one, wavelets))))
    taps, n = F.col("__f.taps"), F.col("__n")
    # output k reads signal index 2 k + 2 - taps + j: every place that reflects onto pos counts
    periods = (F.floor((taps + n) / (2 * n)) + 1).cast("int")
    spots = own.withColumn("__m", F.explode(F.sequence(-periods, periods)))
    spots = spots.select(*keys, "x", "__n", "__f", F.explode(F.array(F.col("pos") + 2 * F.col("__m") * n, 2 * n - 1 - F.col("pos") + 2 * F.col("__m") * n)).alias("__at"))
    at = F.col("__at")
    spots = spots.where((at >= 2 - taps) & (at <= 2 * F.floor((n + taps - 1) / 2) - 1))
    outs = spots.withColumn("k", F.explode(F.sequence(F.greatest(F.ceil((at - 1) / 2), F.lit(0)), F.least(F.floor((at - 2 + taps) / 2), F.floor((n + taps - 1) / 2) - 1))))
    tap = lambda side: F.get(F.col(f"__f.{side}"), (at - 2 * F.col("k") - 2 + taps).cast("int"))
    return outs.groupBy(*keys, F.col("__f.wavelet").alias("wavelet"), "k").agg(F.sum(F.col("x") * tap("low")).alias("approx"), F.sum(F.col("x") * tap("high")).alias("detail"))


def dwt_level(points: DataFrame, wavelet: str, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """One level of (keys, pos, x) in long form by one wavelet as (keys, k, approx, detail)."""
    return dwt_levels(points, (wavelet,), keys).drop("wavelet")


def resampled(series: DataFrame, value: str = "norm", points: int = GRID) -> DataFrame:
    """(id, k, t, x): a series in long form on an even grid, linear between its points; series without a span are left out.

    Each interval between consecutive points generates the grid points that fall in it, so neither the
    grid nor the series is crossed with the other.
    """
    from driftcurve.functions.families import ordered, series_window

    own = series.select("id", "pos", "mjd", F.col(value).alias("x"), F.min("mjd").over(series_window()).alias("low"), F.max("mjd").over(series_window()).alias("high"), F.lag("mjd").over(ordered()).alias("t0"), F.lag(value).over(ordered()).alias("x0"))
    step = (F.col("high") - F.col("low")) / (points - 1)
    grid = lambda k: F.col("low") + k * F.col("step")
    own = own.where("high > low AND t0 IS NOT NULL AND mjd > t0").withColumn("step", step)
    near = lambda t: F.floor((t - F.col("low")) / F.col("step"))
    spread = own.withColumn("k", F.explode(F.sequence(F.greatest(near(F.col("t0")) - 1, F.lit(0)), F.least(near(F.col("mjd")) + 1, F.lit(points - 1)))))
    t = grid(F.col("k"))
    inside = ((t > F.col("t0")) | ((F.col("k") == 0) & (F.col("t0") == F.col("low")))) & ((t <= F.col("mjd")) | ((F.col("k") == points - 1) & (F.col("mjd") == F.col("high"))))
    share = (F.least(t, F.col("high")) - F.col("t0")) / (F.col("mjd") - F.col("t0"))
    return spread.where(inside).select("id", F.col("k").cast("bigint").alias("k"), t.alias("t"), F.when(t >= F.col("high"), F.col("x")).otherwise(F.col("x0") + share * (F.col("x") - F.col("x0"))).alias("x"))


def level_energies(coefficients: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Energy, mean and population deviation of a long table of details."""
    d = F.col("detail")
    return coefficients.groupBy(*keys).agg(F.sum(d * d).alias("energy"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"))


def energy(x: str) -> Column:
    """Sum of squares."""
    return F.sum(F.col(x) * F.col(x))
