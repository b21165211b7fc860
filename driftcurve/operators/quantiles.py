"""Exact quantiles of many columns, without bringing a column's values together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window as W, functions as F

ACCURACY = 10_000


def number(c: str) -> Column:
    """A column as a double; what is no number is null."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def sketched(df: DataFrame, columns: list[str], qs: tuple[float, ...], by: str | None, accuracy: int, also: list[Column]) -> list[Row]:
    """One aggregate: per group the values `e{i}` at the quantiles' lower and upper ends in turn, the numbers `n{i}` of values, and what else is asked for."""
    d = 2.0 / accuracy
    ends = F.array(*(F.lit(min(1.0, max(0.0, q + s * d))) for q in qs for s in (-1, 1)))
    aggs = [f for i, c in enumerate(columns) for f in (F.percentile_approx(number(c), ends, accuracy).alias(f"e{i}"), F.count(number(c)).alias(f"n{i}"))]
    return (df.groupBy(F.col(by).alias("grp")) if by else df.groupBy(F.lit(0).alias("grp"))).agg(*aggs, *also).collect()


def exact_quantiles(df: DataFrame, columns: list[str], qs: tuple[float, ...] = (0.5,), by: str | None = None, accuracy: int = ACCURACY, also: list[Column] | None = None) -> tuple[DataFrame, list[Row]]:
    """(grp, feature, q, value) of each column and quantile, per value of `by` (few; 0 without it), and the first aggregate's rows, with `also` in them.

    A sketch bounds the two values that a quantile lies between. One pass counts what is below each bound; another keeps
    the few parts in `accuracy` of the values that lie within, which alone are counted by value and sorted. Quantiles
    between two values are linear. The driver holds two bounds a group, column and quantile. Of fewer than 2 x `accuracy`
    values all lie within: a bound may miss the neighbour of a rank by less than one.
    """
    spark = df.sparkSession
    rows = sketched(df, columns, qs, by, accuracy, also or [])
    group = F.col(by) if by else F.lit(0)
    ends = lambda r, i, k: tuple(r[f"e{i}"][2 * k : 2 * k + 2]) if r[f"n{i}"] >= 2 * accuracy else (float("-inf"), float("inf"))
    known = [(r["grp"], i, k, *ends(r, i, k), r[f"n{i}"]) for r in rows for i in range(len(columns)) if r[f"n{i}"] for k in range(len(qs))]
    if not known:
        kind = dict(df.dtypes)[by] if by else "int"
        return spark.createDataFrame([], f"grp {kind}, feature string, q double, value double"), rows
    inside = lambda i: [(g, lo, hi) for g, c, _, lo, hi, _ in known if c == i]
    any_of = lambda tests: F.array_contains(F.array(*tests), True) if tests else F.lit(False)
    within = lambda i, c: any_of([group.eqNullSafe(F.lit(g)) & number(c).between(lo, hi) for g, lo, hi in inside(i)])
    below = [F.count_if(group.eqNullSafe(F.lit(g)) & (number(columns[i]) < lo)).alias(f"b{j}") for j, (g, i, _, lo, _, _) in enumerate(known)]
    sums = df.agg(*below)
    parts = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(columns[i]).alias("of"), F.lit(float(qs[k])).alias("q"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(n).alias("n"), F.col(f"b{j}").alias("b")) for j, (g, i, k, lo, hi, n) in enumerate(known)))
    bounds = sums.select(F.inline(parts))
    values = F.filter(F.array(*(F.struct(F.lit(c).alias("feature"), F.when(within(i, c), number(c)).alias("v")) for i, c in enumerate(columns))), lambda x: x["v"].isNotNull())
    counts = df.select(group.alias("grp"), F.explode(values).alias("x")).groupBy("grp", "x.feature", F.col("x.v").alias("v")).agg(F.count("*").alias("c"))
    same = F.col("grp").eqNullSafe(F.col("g")) & (F.col("feature") == F.col("of")) & F.col("v").between(F.col("lo"), F.col("hi"))
    upto = F.col("b") + F.sum("c").over(W.partitionBy("grp", "feature", "q").orderBy("v"))
    # as many bounds as columns, quantiles and groups, all of them literals of this plan
    close = counts.join(F.broadcast(bounds), same).withColumn("upto", upto)
    h = (F.col("n") - 1) * F.col("q")
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col("v")))
    low, high, rest = at(F.floor(h)), at(F.ceil(h)), F.max(h - F.floor(h))
    return close.groupBy("grp", "feature", "q").agg((low + (high - low) * rest).alias("value")), rows
