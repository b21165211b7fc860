"""Scores of predictions against labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftcurve.sources.state import Store

#: What a set without a model scores.
NO_MODEL = {"recall": 0.0, "precision": 0.0, "f1": 0.0, "auc": 0.5, "pr_auc": 0.0, "logloss": 1.0, "brier": 0.25, "ice": 1.0}
CLIP, BINS = 1e-15, 10


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion(df: DataFrame, p: str = "p", y: str = "y", threshold: float = 0.5, strict: bool = False) -> DataFrame:
    """One row: recall, precision, f1, logloss, brier and calibration error (ice) over ten equal bins.

    Bins are pre-aggregated; what is left to combine is ten rows.
    """
    yes = F.col(p) > threshold if strict else F.col(p) >= threshold
    q = F.least(F.greatest(F.col(p), F.lit(CLIP)), F.lit(1 - CLIP))
    bins = df.groupBy(F.least(F.floor(F.col(p) * BINS), F.lit(BINS - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.count_if(yes & (F.col(y) == 1)).alias("tp"), F.count_if(yes & (F.col(y) == 0)).alias("fp"), F.count_if(~yes & (F.col(y) == 1)).alias("fn"),
        F.sum(p).alias("sp"), F.sum(F.col(y).cast("double")).alias("sy"), F.sum(-(F.col(y) * F.ln(q) + (1 - F.col(y)) * F.ln(1 - q))).alias("ll"), F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("b"),
    )
    s = lambda c: F.sum(c)
    tp, fp, fn, n = s("tp"), s("fp"), s("fn"), s("n")
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return bins.agg(n.alias("n"), recall.alias("recall"), precision.alias("precision"), _ratio(2 * precision * recall, precision + recall).alias("f1"), F.try_divide(s("ll"), n).alias("logloss"), F.try_divide(s("b"), n).alias("brier"), F.try_divide(F.sum(F.abs(F.col("sp") - F.col("sy"))), n).alias("ice"))


def ranking_areas(df: DataFrame, p: str = "p", y: str = "y") -> DataFrame:
    """ROC-AUC (mid-ranks) and PR-AUC (average precision) of the probabilities as they are.

    Rows of one probability become one count. Counts are dealt out by ranges of the probability and written; a range's
    sums are added up in order, over as many rows as there are ranges, and each range is then sorted by itself.
    """
    spark = df.sparkSession
    counts = df.groupBy(F.col(p).cast("double").alias("q")).agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(ranges, F.col("q").desc()).withColumn("part", F.spark_partition_id())
    dealt = Store(spark, "areas").table(dealt, "counts")
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(F.col("part").alias("of")).agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn")).withColumnRenamed("of", "part")
    before = totals.select(F.col("part").alias("of"), *(F.coalesce(F.sum(t).over(ahead), F.lit(0)).alias(t) for t in ("tp", "tn")))
    w = W.partitionBy("part").orderBy(F.col("q").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    c = dealt.join(before, F.col("part") == F.col("of")).withColumns({"cp": F.col("tp") + F.sum("pos").over(w), "cn": F.col("tn") + F.sum("neg").over(w)})
    pos, neg = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    auc = F.coalesce(F.try_divide(F.sum(F.col("neg").cast("double") * (F.col("cp") - F.col("pos") / 2)), pos * neg), F.lit(0.5))
    ap = _ratio(F.sum(F.col("pos") * F.try_divide(F.col("cp"), F.col("cp") + F.col("cn"))), pos)
    return c.agg(auc.alias("auc"), ap.alias("pr_auc"))


def out_of_bag(members: DataFrame, trained: DataFrame, labels: DataFrame) -> DataFrame:
    """(recall, precision, coverage) from members' predictions (model, row_index, p) for rows that they did not train on (model, row_index)."""
    free = members.join(trained.select(F.col("model").alias("__m"), F.col("row_index").alias("__r")), (F.col("model") == F.col("__m")) & (F.col("row_index") == F.col("__r")), "left_anti")
    mean = free.groupBy(F.col("row_index").alias("__i")).agg(F.avg("p").alias("__p"))
    own = labels.join(mean, F.col("row_index") == F.col("__i"), "left")
    return out_of_bag_means(own.select(F.col("__p").alias("p"), "y"))


def out_of_bag_means(df: DataFrame) -> DataFrame:
    """(oob_recall, oob_precision, coverage) of labelled rows (p, y) whose p is the mean of the members that did not train on them, null if all did."""
    yes = F.col("p") > 0.5
    tp, fp, fn = F.count_if(yes & (F.col("y") == 1)), F.count_if(yes & (F.col("y") == 0)), F.count_if(~yes & (F.col("y") == 1))
    return df.agg(_ratio(tp, tp + fn).alias("oob_recall"), _ratio(tp, tp + fp).alias("oob_precision"), _ratio(F.count("p"), F.count("*")).alias("coverage"))
