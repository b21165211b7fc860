"""Column factories for series in long form: one row per point, keyed by (id, pos).

A family names the window columns that it needs, in stages, and its aggregates. Families combine: all
windows share one partitioning by id and the aggregate reuses it, so any number of families over a
table costs a single shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W, WindowSpec

EPSILON = 1e-10


def series_window() -> WindowSpec:
    """All points of a series."""
    return W.partitionBy("id")


def ordered() -> WindowSpec:
    return series_window().orderBy("pos")


def so_far() -> WindowSpec:
    return ordered().rowsBetween(W.unboundedPreceding, W.currentRow)


#: How columns with a series' sorted values start; they serve the results that are read from them and go.
SORTED = "__sorted_"


@dataclass
class Family:
    """Window columns in stages, aggregates by series, and results made of the aggregates."""

    stages: list[dict[str, Column]] = field(default_factory=list)
    aggregates: list[Column] = field(default_factory=list)
    results: dict[str, Column] = field(default_factory=dict)

    def __add__(self, other: Family) -> Family:
        stages = [{**a, **b} for a, b in zip(self.stages, other.stages, strict=False)]
        longer = max(self.stages, other.stages, key=len)
        return Family(stages + longer[len(stages) :], self.aggregates + other.aggregates, self.results | other.results)


def apply(series: DataFrame, *families: Family) -> DataFrame:
    """One row per id with the families' aggregates and results."""
    whole = reduce(lambda a, b: a + b, families)
    for stage in whole.stages:
        series = series.withColumns(stage)
    out = series.groupBy("id").agg(*whole.aggregates)
    if whole.results:
        out = out.withColumns(whole.results)
    return out.drop(*(c for c in out.columns if c.startswith(SORTED)))


def sorted_values(x: Column | str, name: str) -> Column:
    """A column's values in order: collected once per series, and quantiles, extremes and counts are read from them."""
    value = F.col(x) if isinstance(x, str) else x
    return F.sort_array(F.collect_list(value + F.lit(0.0))).alias(SORTED + name)  # minus zero counts as zero


def element(name: str, i: Column) -> Column:
    return F.get(SORTED + name, i.cast("int"))


def linear_quantile(name: str, q: float) -> Column:
    at = (F.size(SORTED + name) - 1) * F.lit(q)
    low = element(name, F.floor(at))
    return low + (at - F.floor(at)) * (F.coalesce(element(name, F.floor(at) + 1), low) - low)


def place(x: str) -> Column:
    """A point's position if it has a value."""
    return F.when(F.col(x).isNotNull(), F.col("pos"))


def first_at(value: Column, by: Column) -> Column:
    return F.min_by(value, by)


def arg_min(x: str) -> Column:
    """Position of the first smallest value, counted from the first value."""
    p = place(x)
    return (F.min_by(p, F.when(p.isNotNull(), F.struct(F.col(x), p))) - F.min(p)).cast("bigint")


def arg_max(x: str) -> Column:
    p = place(x)
    return (F.min_by(p, F.when(p.isNotNull(), F.struct(-F.col(x), p))) - F.min(p)).cast("bigint")


def count_where(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def nearest_quantile(name: str, q: float) -> Column:
    """The element at floor((n - 1) q + 1/2) of the sorted values."""
    return element(name, F.floor((F.size(SORTED + name) - 1) * q + 0.5))


#: What main_stats computes of a column; entropy only where it is asked for.
MAIN = ("mean", "std", "min", "max", "median", "q25", "q75", "skewness", "kurtosis", "first", "last", "arg_min", "arg_max", "n_unique", "trend_changes", "entropy")


def main_stats(x: str, name: str | None = None, entropy: bool = True) -> Family:
    """The basic statistics of a column; null values (a step before the first point) are no part of the series.

    Undefined ones are null: std of one point, moments of a constant, entropy unless all values are positive.
    """
    n = name or x
    c = F.col(x)
    d, pd = f"__{n}_d", f"__{n}_pd"
    total = F.sum(c)
    found = {
        "mean": F.avg(c), "std": F.stddev_samp(c), "skewness": F.skewness(c), "kurtosis": F.kurtosis(c),
        "first": F.min_by(c, place(x)), "last": F.max_by(c, place(x)), "arg_min": arg_min(x), "arg_max": arg_max(x),
        "trend_changes": count_where(F.signum(F.col(d)) != F.signum(F.col(pd))),
    }
    size = F.size(SORTED + n)
    read = {
        "min": element(n, F.lit(0)), "max": element(n, size - 1), "median": linear_quantile(n, 0.5), "q25": nearest_quantile(n, 0.25), "q75": nearest_quantile(n, 0.75),
        "n_unique": F.size(F.array_distinct(SORTED + n)).cast("bigint"),
    }
    if entropy:
        found["entropy"] = F.when(F.min(c) > 0, F.ln(total) - F.try_divide(F.sum(c * F.ln(c)), total))
    aggregates = [sorted_values(c, n), *(v.alias(f"{n}_{k}") for k, v in found.items())]
    return Family([{d: c - F.lag(c).over(ordered())}, {pd: F.lag(d).over(ordered())}], aggregates, {f"{n}_{k}": v for k, v in read.items()})


def run_length(cond: Column) -> Column:
    """Points since `cond` last failed, this one included."""
    failed = F.max(F.when(~cond, F.col("pos"))).over(so_far())
    return F.when(cond, F.col("pos") - F.coalesce(failed, F.min("pos").over(series_window()) - 1))


def shape(x: str, name: str | None = None, times: str | None = None) -> Family:
    """Dips, runs, turning points and asymmetry of a column; with `times` also those measured in time."""
    n = name or x
    c = F.col(x)
    col = lambda k: f"__{n}_{k}"
    g = lambda k: F.col(col(k))
    yes = lambda cond: F.coalesce(cond, F.lit(False))
    stages = [
        {
            col("prev"): F.lag(c).over(ordered()), col("next"): F.lead(c).over(ordered()), col("n"): F.count(c).over(series_window()), col("i"): F.col("pos") - F.min(place(x)).over(series_window()),
            col("below"): yes(c < -2), col("above"): yes(c > 1), col("up"): yes(c > F.lag(c).over(ordered())), col("down"): yes(c < F.lag(c).over(ordered())),
        },
        {col(f"run_{k}"): run_length(g(k)) for k in ("below", "above", "up", "down")} | {col(f"new_{k}"): g(k) & ~F.coalesce(F.lag(col(k)).over(ordered()), F.lit(False)) for k in ("below", "above")},
    ]
    size = F.count(c)
    low = arg_min(x)
    longest = {k: F.coalesce(F.max(g(f"run_{k}")), F.lit(0)).cast("bigint") for k in ("below", "above", "up", "down")}
    minima, maxima = count_where((c < g("prev")) & (g("next") > c)), count_where((c > g("prev")) & (g("next") < c))
    crossings = count_where(F.signum(c) * F.signum(g("prev")) < 0)
    isolated = count_where((c < -2) & (F.coalesce(g("prev"), F.lit(0.0)) >= -2) & (F.coalesce(g("next"), F.lit(0.0)) >= -2))
    half = F.floor(g("n") / 2)
    head, tail = F.avg(F.when(g("i") < half, c)), F.avg(F.when(g("i") >= g("n") - half, c))
    runs_b, runs_a, all_b, all_a = count_where(g("new_below")), count_where(g("new_above")), count_where(g("below")), count_where(g("above"))
    one = lambda v: F.greatest(v, F.lit(1))
    found = {
        "n_below_3sigma": count_where(c < -3), "max_consecutive_below_2sigma": longest["below"], "rise_decay_idx_ratio": F.try_divide(low + 1, size - low), "n_local_minima": minima, "n_zero_crossings": crossings,
        "peak_position_ratio": low / one(size - 1), "max_consecutive_above_1sigma": longest["above"], "longest_monotonic_increase": longest["up"], "longest_monotonic_decrease": longest["down"], "n_isolated_below_2sigma": isolated,
        "frac_below_2sigma": F.coalesce(F.try_divide(count_where(c < -2), size), F.lit(0.0)), "frac_below_1sigma": F.coalesce(F.try_divide(count_where(c < -1), size), F.lit(0.0)), "n_local_maxima": maxima,
        "peak_depth": F.avg(c) - F.min(c), "first_second_half_diff": F.coalesce(head - tail, F.lit(0.0)), "minima_maxima_ratio": (minima + 1) / (maxima + 1), "monotonic_ratio": (longest["up"] + 1) / (longest["down"] + 1),
        "n_runs_below_2sigma": runs_b, "mean_run_below_2sigma": all_b / one(runs_b), "n_runs_above_1sigma": runs_a, "mean_run_above_1sigma": all_a / one(runs_a), "run_length_ratio": ((all_b + 1) / one(runs_b)) / ((all_a + 1) / one(runs_a)),
    }
    out = [v.alias(f"{n}_{k}") for k, v in found.items()]
    if times:
        p = place(x)
        t = F.col(times)
        start, end = F.min_by(t, p), F.max_by(t, p)
        at = F.min_by(t, F.when(p.isNotNull(), F.struct(c, p)))
        out += [((at - start) / (end - at + EPSILON)).alias(f"{n}_rise_decay_time_ratio"), (end - start).alias("mjd_span")]
    return Family(stages, out)


#: Fraction features: name of the result and the count that it divides by the number of points.
FRACTIONS = {"frac_below_3sigma": "n_below_3sigma", "max_consecutive_frac_below_2sigma": "max_consecutive_below_2sigma", "frac_local_minima": "n_local_minima", "frac_zero_crossings": "n_zero_crossings"}


def with_fractions(features: DataFrame, name: str = "norm") -> DataFrame:
    """Add the counts that are there as fractions of `npoints`; an error if there are none."""
    there = {f"{name}_{k}": F.try_divide(F.col(f"{name}_{v}"), F.col("npoints")) for k, v in FRACTIONS.items() if f"{name}_{v}" in features.columns}
    if not there or "npoints" not in features.columns:
        raise ValueError(f"none of {sorted(FRACTIONS.values())} with prefix {name}_ and npoints among the columns")
    return features.withColumns(there)


#: Of the split statistics those that are always there.
BASIC_SPLIT = ("len", "mean", "std", "min", "max", "range", "slope")


def split_stats(x: str, side: str, which: str, index: str = "mag", name: str | None = None, steps: bool = False, additional: bool = True) -> Family:
    """Statistics of a column before (side "to", exclusive) or from (side "from") the first extremum of `index`.

    A column of steps has one value fewer than its series, and its "from" part is as long as the
    series' own: it starts one step earlier, so both parts then share a step.
    """
    if side not in ("to", "from") or which not in ("argmin", "argmax"):
        raise ValueError(f"{side}, {which}")
    n = f"{name or x}_{side}_{which}"
    col = lambda k: f"__{n}_{k}"
    at = F.min_by("pos", F.struct(F.col(index) if which == "argmin" else -F.col(index), F.col("pos"))).over(series_window())
    own = F.col("pos") - 1 if steps else F.col("pos")
    k = F.col(f"__{index}_{which}")
    start = F.greatest(k - 1, F.lit(0)) if steps else k
    value = F.when(own < k if side == "to" else own >= start, F.col(x))
    c = F.col(col("x"))
    stages = [{f"__{index}_{which}": at}, {col("x"): value}]
    p = F.when(c.isNotNull(), F.col("pos"))
    name = lambda k: f"{n}_{k}"
    aggregates = {
        "len": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "slope": (F.max_by(c, p) - F.min_by(c, p)) / F.greatest(F.count(c), F.lit(1)),
    }
    if additional:
        aggregates["energy"] = F.coalesce(F.sum(c * c), F.lit(0.0))
    # the rest is read from the part's sorted values, one pass for each of its deviations
    size, mu, sd = F.size(SORTED + n), F.col(name("mean")), F.col(name("std"))
    moment = lambda k: F.try_divide(F.aggregate(SORTED + n, F.lit(0.0), lambda a, x: a + reduce(lambda u, _: u * (x - mu), range(k - 1), x - mu)), size)
    beyond = lambda test: F.size(F.filter(SORTED + n, test)).cast("bigint")
    low, high, q25, q75 = element(n, F.lit(0)), element(n, size - 1), linear_quantile(n, 0.25), linear_quantile(n, 0.75)
    read = {
        "min": low, "max": high, "range": high - low,
        "median": linear_quantile(n, 0.5), "q25": q25, "q75": q75, "iqr": q75 - q25, "skewness": moment(3) / (sd * sd * sd + EPSILON), "kurtosis": moment(4) / (sd * sd * sd * sd + EPSILON) - 3,
        "n_above_2sigma": beyond(lambda x: x > mu + 2 * sd), "n_below_2sigma": beyond(lambda x: x < mu - 2 * sd), "n_above_3sigma": beyond(lambda x: x > mu + 3 * sd), "n_below_3sigma": beyond(lambda x: x < mu - 3 * sd),
    }
    return Family(stages, [sorted_values(c, n), *(v.alias(name(k)) for k, v in aggregates.items())], {name(k): v for k, v in read.items() if additional or k in BASIC_SPLIT})


def legacy_stats(x: str) -> Family:
    """The older set: population moments, share below three deviations, amplitude."""
    c, sd = F.col(x), F.col(f"__{x}_sd0")
    found = {"std": F.stddev_pop(c), "skewness": F.skewness(c), "kurtosis": F.kurtosis(c), "frac_below_3sigma": F.avg((c < -3 * sd).cast("double")), "amplitude_sigma": F.max(c) - F.min(c), "mean": F.avg(c), "median": F.median(c)}
    return Family([{f"__{x}_sd0": F.stddev_pop(c).over(series_window())}], [v.alias(f"{x}_{k}") for k, v in found.items()])
