"""Ranking features by how they differ between rare rows and the population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from driftcurve.operators.quantiles import ACCURACY, exact_quantiles
from driftcurve.sources.state import Store

EPSILON = 1e-10
STATS = ("mean", "median", "std")


def exact_medians(df: DataFrame, columns: list[str], accuracy: int = ACCURACY) -> DataFrame:
    """(feature, median) of each column, exact, without bringing a column's values together."""
    return exact_quantiles(df, columns, (0.5,), accuracy=accuracy)[0].select("feature", F.col("value").alias("median"))


def tall_stats(population: DataFrame, rare: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """(feature, mean, median, std, n) of each column, with _pop and _rare behind the names.

    Both tables are written as one, once, so what makes them runs once. One aggregate gives means, deviations and the
    medians' bounds of both; medians are exact, or with `accuracy` those of a sketch in the same aggregate, with ranks
    within n / accuracy.
    """
    spark, sides = population.sparkSession, (("pop", population), ("rare", rare))
    one = [df.select(F.lit(side).alias("side"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns))) for side, df in sides]
    both = Store(spark, "ranking").table(one[0].unionByName(one[1]), "rows")
    names = [f"c{i}" for i in range(len(columns))]
    also = [F.count("*").alias("n")] + [f(c).alias(f"{k}|{c}") for c in names for k, f in (("mean", F.avg), ("std", F.stddev_samp))]
    if accuracy is None:
        found, rows = exact_quantiles(both, names, (0.5,), "side", also=also)
        medians = {(r["grp"], r["feature"]): r["value"] for r in found.collect()}
    else:
        rows = both.groupBy(F.col("side").alias("grp")).agg(*also, *(F.percentile_approx(c, 0.5, accuracy).alias(f"median|{c}") for c in names)).collect()
        medians = {(r["grp"], c): r[f"median|{c}"] for r in rows for c in names}
    of = {r["grp"]: r for r in rows}
    got = lambda side, key: of[side][key] if side in of else None
    table = [(c, *(v for side, _ in sides for v in (got(side, f"mean|{names[i]}"), medians.get((side, names[i])), got(side, f"std|{names[i]}"), got(side, "n") or 0))) for i, c in enumerate(columns)]
    return spark.createDataFrame(table, "feature string, " + ", ".join(f"mean_{s} double, median_{s} double, std_{s} double, n_{s} bigint" for s, _ in sides))


def signed_log2(x: Column) -> Column:
    return F.when(x > 0, F.log2(x + EPSILON)).otherwise(-F.log2(F.abs(x) + EPSILON))


def rank_features(population: DataFrame, rare: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """Per feature both tables' statistics, their ratios (with the population's sign), signed log ratios and effect sizes, strongest first."""
    if not columns:
        raise ValueError("no common numeric columns")
    df = tall_stats(population, rare, columns, accuracy)
    for k in STATS:
        pop, own = F.col(f"{k}_pop"), F.col(f"{k}_rare")
        df = df.withColumn(f"{k}_ratio", F.when(pop >= 0, own / (F.abs(pop) + EPSILON)).otherwise(-own / (F.abs(pop) + EPSILON)))
        df = df.withColumn(f"{k}_log_ratio", signed_log2(F.col(f"{k}_ratio")))
    n, m = F.col("n_pop"), F.col("n_rare")
    pooled = F.sqrt(F.try_divide((n - 1) * F.col("std_pop") * F.col("std_pop") + (m - 1) * F.col("std_rare") * F.col("std_rare"), n + m - 2))
    for k in ("mean", "median"):
        df = df.withColumn(f"cohens_d_{k}", (F.col(f"{k}_rare") - F.col(f"{k}_pop")) / (pooled + EPSILON))
    largest = F.coalesce(F.array_max(F.array(*(F.abs(f"{k}_log_ratio") for k in STATS))), F.lit(0.0))
    return df.withColumn("max_abs_log_ratio", largest).orderBy(F.col("max_abs_log_ratio").desc(), "feature")
