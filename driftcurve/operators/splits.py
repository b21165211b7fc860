"""Splitting rows at random, reproducibly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from driftcurve.operators.ordering import hash_ranked
from driftcurve.operators.quantiles import exact_quantiles

STRATIFY, BINS, ROWS_PER_BIN = ("norm_amplitude_sigma", "npoints"), 5, 10


def random_split(df: DataFrame, train: float, validation: float, seed: int = 42, key: str = "row_index", strata: Column | None = None) -> DataFrame:
    """Add `role`: int(n * share) rows each for train and validation in hashed order, the rest held_out; per stratum if given."""
    ranked = hash_ranked(df, seed, (key,), strata)
    a, b = F.floor(F.col("__n") * train + 1e-9), F.floor(F.col("__n") * validation + 1e-9)
    role = F.when(F.col("__rank") <= a, "train").when(F.col("__rank") <= a + b, "validation").otherwise("held_out")
    return ranked.withColumn("role", role).drop("__rank", "__n")


def quantile_bin(column: str, edges: list[float]) -> Column:
    """The number of inner edges that a value reaches."""
    return reduce(lambda a, b: a + b, ((F.col(column) >= e).cast("int") for e in edges), F.lit(0))


def stratified_split(df: DataFrame, train: float = 0.1, validation: float = 0.4, seed: int = 42, columns: tuple[str, ...] | None = None, exclude: DataFrame | None = None, key: str = "row_index", held_out: float | None = None) -> DataFrame:
    """A split within strata of quantile bins of (at most two) columns; at random where there are too few rows or no such column.

    Bins are min(5, n // 10) per column; their edges are exact percentiles, found without bringing a column together.
    """
    if exclude is not None:
        df = df.join(exclude.select(F.col("row_index").alias("__x")), F.col(key) == F.col("__x"), "left_anti")
    names = [c for c in (columns or STRATIFY) if c in df.columns][:2]
    if held_out == 0:
        validation = 1 - train
    if not names:
        return random_split(df, train, validation, seed, key)
    n = df.count()
    bins = min(BINS, n // ROWS_PER_BIN)
    if bins < 2:
        return random_split(df, train, validation, seed, key)
    found = exact_quantiles(df, names, tuple(i / bins for i in range(1, bins)))[0].orderBy("feature", "q").collect()
    edges = {c: [r["value"] for r in found if r["feature"] == c] for c in names}
    label = reduce(lambda a, c: a * bins + quantile_bin(c, edges[c]), names, F.lit(0))
    return random_split(df, train, validation, seed, key, label)


def overlapping(roles: DataFrame, key: tuple[str, ...] = ("row_index",)) -> DataFrame:
    """The keys that stand in more than one role."""
    return roles.groupBy(*key).agg(F.min("role").alias("low"), F.max("role").alias("high")).where("low <> high").select(*key)


def assert_disjoint(roles: DataFrame, key: tuple[str, ...] = ("row_index",)) -> None:
    """Raise if a row stands in more than one role; one aggregate over the keys, of which at most three rows come back."""
    both = overlapping(roles, key).limit(3).collect()
    if both:
        raise ValueError(f"rows in more than one role, among them {[tuple(r) for r in both]}")
