"""Choosing rows by predicted probabilities: thresholds, top-k, consensus, pseudo-labels, review, bans.

Prediction tables have `row_index`, `p` and, with an ensemble, `p_boot` (an array of the members'
probabilities). Everything here is a function from tables to tables; no model is needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from driftcurve.operators.ordering import hash_ranked, hashed

MIN_CONSENSUS_MODELS, CONSENSUS_FRACTION = 2, 0.5
POSITIVE_PREFILTER, NEGATIVE_SUBSAMPLE = 50, 2
POSITIVE_WEIGHT_SCALE = 0.5


@dataclass(frozen=True)
class Thresholds:
    """Defaults of the self-training rules."""

    pseudo_pos: float = 0.95
    pseudo_neg: float = 0.01
    consensus: float = 0.95
    neg_consensus_low: float = 0.1
    max_pseudo_pos: int = 100
    max_pseudo_neg: int = 200_000
    min_pseudo_pos_threshold: float = 0.90
    max_pseudo_neg_threshold: float = 0.01
    min_pseudo_pos: int = 3
    max_pseudo_pos_cap: int = 200
    relax_every: int = 20
    relax_pos: float = 0.005
    relax_neg: float = 0.005
    relax_max_pos: int = 1
    tighten_pos: float = 0.01
    tighten_neg: float = 0.02
    tighten_max_pos: int = 3
    highest_pos: float = 0.999
    lowest_neg: float = 0.01
    bootstrap_std: float = 0.03
    pseudo_pos_removal: float = 0.91
    pseudo_neg_promotion: float = 0.15
    instability_std: float = 0.2
    instability_mean: float = 0.7
    seed_neg_removal: float = 0.2
    seed_neg_removal_mean: float = 0.85
    ban_iterations: int = 5
    initial_pos_weight: float = 0.2
    max_pos_weight: float = 1.2
    initial_neg_weight: float = 0.8
    weight_step: float = 0.1
    imbalance: float = 20.0
    class_weight_divisor: float = 1.0
    top_k: int = 10_000
    prevalence: float = 0.001


def between(df: DataFrame, low: float, high: float) -> DataFrame:
    """Rows whose probability (`flare_prob` if there is one, else `probability`) lies in [low, high]."""
    name = next((c for c in ("flare_prob", "probability") if c in df.columns), None)
    if name is None or not 0 <= low <= high <= 1:
        raise ValueError("need a probability column and 0 <= low <= high <= 1")
    return df.where(F.col(name).between(low, high))


def sample(df: DataFrame, n: int, seed: int, key: str = "row_index", per: str | None = None) -> DataFrame:
    """n rows in hashed order, of each value of `per` if given; no group is sorted in one task."""
    if per is None:
        return df.orderBy(hashed(seed, key), key).limit(n)
    packed = F.struct(hashed(seed, key).alias("h"), *df.columns)
    if n == 1:
        return df.groupBy(per).agg(F.min(packed).alias("__r")).select("__r.*").drop("h")
    ranked = hash_ranked(df, seed, (key,), F.col(per))
    return ranked.where(F.col("__rank") <= n).drop("__rank", "__n")


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows: each task keeps k, one merges them."""
    return df.orderBy(*order).limit(k)


def gather(df: DataFrame, indices: DataFrame, key: str = "row_index") -> DataFrame:
    """df[indices]: a row for each wanted (place, index), repeats included, to be ordered by `place`; indices out of range give none."""
    return indices.select("place", F.col("index").alias("__i")).join(df, F.col("__i") == F.col(key)).drop("__i")


def gather_two(pool: DataFrame, known: DataFrame, indices: DataFrame) -> DataFrame:
    """Rows of two tables by (place, from_known, index), with columns that one lacks as null."""
    a = gather(pool, indices.where(~F.col("from_known")))
    b = gather(known, indices.where(F.col("from_known")))
    return a.withColumn("from_known", F.lit(False)).unionByName(b.withColumn("from_known", F.lit(True)), allowMissingColumns=True)


# --- ensembles ------------------------------------------------------------------------------------


def ensemble_stats(p_boot: str = "p_boot") -> dict[str, Column]:
    """Mean, population deviation and consensus (1 - deviation) of an ensemble; without members 0, 0 and 1."""
    n = F.size(p_boot)
    mean = F.try_divide(F.aggregate(p_boot, F.lit(0.0), lambda a, x: a + x), n)
    squares = F.aggregate(p_boot, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    std = F.sqrt(F.try_divide(squares, n))
    return {"boot_mean": F.coalesce(mean, F.lit(0.0)), "boot_std": F.coalesce(std, F.lit(0.0)), "consensus": F.coalesce(1 - std, F.lit(1.0))}


def low_votes(threshold: float, p_boot: str = "p_boot") -> Column:
    return F.size(F.filter(p_boot, lambda x: x < threshold))


def agree_low(threshold: float, p_boot: str = "p_boot") -> Column:
    """At least half of the members, and at least two, are below; true without members."""
    n = F.size(p_boot)
    return (n == 0) | (low_votes(threshold, p_boot) >= F.greatest(F.lit(MIN_CONSENSUS_MODELS), F.floor(n * CONSENSUS_FRACTION)))


def agree_high(threshold: float, p_boot: str = "p_boot") -> Column:
    """All members are above; true without members."""
    return F.forall(p_boot, lambda x: x > threshold)


def confidence(p: str = "p", mean: str = "boot_mean", p_boot: str = "p_boot") -> Column:
    """The mean of the model's and the ensemble's probability; the model's alone without an ensemble."""
    return F.when(F.size(p_boot) > 0, (F.col(p) + F.col(mean)) / 2).otherwise(F.col(p))


def curriculum(confidence: Column, recall: Column | float, phases: tuple[float, float] = (0.5, 0.65), cuts: tuple[float, float, float] = (0.95, 0.85, 0.70), reduced: float = 0.7) -> Column:
    """A sample's weight by how sure its label is and how mature the model is, in three phases of recall."""
    recall = recall if isinstance(recall, Column) else F.lit(recall)
    sure = F.when(confidence > cuts[0], 1.0)
    return F.when(recall < phases[0], sure.otherwise(0.0)).when(recall < phases[1], sure.when(confidence > cuts[1], reduced).otherwise(0.0)).otherwise(sure.when(confidence > cuts[2], confidence).otherwise(0.0))


def pseudo_weight(label: int, successful: int, t: Thresholds = Thresholds()) -> float:
    if label == 1:
        return min(t.max_pos_weight, t.initial_pos_weight + successful * t.weight_step * POSITIVE_WEIGHT_SCALE)
    return min(1.0, t.initial_neg_weight + successful * t.weight_step)


# --- pseudo-labels --------------------------------------------------------------------------------


def unbanned(df: DataFrame, bans: DataFrame, label: int, iteration: int) -> DataFrame:
    """Rows without a ban on this label that has not expired. Applied after a top-k, so fewer than k may remain."""
    live = bans.where((F.col("label") == label) & (F.col("expires_at") > iteration)).select(F.col("row_index").alias("__b"))
    return df.join(live, F.col("row_index") == F.col("__b"), "left_anti")


def candidates(preds: DataFrame, excluded: DataFrame, threshold: float, above: bool) -> DataFrame:
    """Predictions strictly beyond a threshold whose rows are not excluded (labelled, held out, validation, tracked)."""
    beyond = preds.where(F.col("p") > threshold if above else F.col("p") < threshold)
    return beyond.join(excluded.select(F.col("row_index").alias("__x")), F.col("row_index") == F.col("__x"), "left_anti")


def pseudo_negatives(preds: DataFrame, excluded: DataFrame, bans: DataFrame, iteration: int, t: Thresholds = Thresholds(), threshold: float | None = None, successful: int = 0, seed: int = 42) -> DataFrame:
    """New negatives: a subsample of twice as many candidates, those with consensus, the surest k, less the banned."""
    found = candidates(preds, excluded, t.pseudo_neg if threshold is None else threshold, above=False)
    found = sample(found, NEGATIVE_SUBSAMPLE * t.max_pseudo_neg, seed)
    found = found.withColumns(ensemble_stats()).where(agree_low(t.neg_consensus_low)).withColumn("confidence", 1 - confidence())
    chosen = unbanned(top(found, t.max_pseudo_neg, F.col("confidence").desc(), F.col("row_index")), bans, 0, iteration)
    return labelled(chosen, 0, iteration, pseudo_weight(0, successful, t), "pseudo_neg")


def pseudo_positives(preds: DataFrame, excluded: DataFrame, bans: DataFrame, iteration: int, t: Thresholds = Thresholds(), threshold: float | None = None, most: int | None = None, successful: int = 0) -> DataFrame:
    """New positives: the 50 k likeliest candidates, those on which all members agree closely, the best k, less the banned."""
    k = t.max_pseudo_pos if most is None else most
    found = candidates(preds, excluded, t.pseudo_pos if threshold is None else threshold, above=True)
    found = top(found, k * POSITIVE_PREFILTER, F.col("p").desc(), F.col("row_index"))
    found = found.withColumns(ensemble_stats()).where(agree_high(t.consensus) & (F.col("boot_std") < t.bootstrap_std)).withColumn("confidence", confidence())
    chosen = unbanned(top(found, k, F.col("consensus").desc(), F.col("confidence").desc(), F.col("row_index")), bans, 1, iteration)
    return labelled(chosen, 1, iteration, pseudo_weight(1, successful, t), "pseudo_pos")


SAMPLE_COLUMNS = ("row_index", "label", "weight", "source", "added_iter", "confidence", "consensus_score", "from_known")


def labelled(chosen: DataFrame, label: int, iteration: int, weight: float, source: str) -> DataFrame:
    return chosen.select("row_index", F.lit(label).alias("label"), F.lit(float(weight)).alias("weight"), F.lit(source).alias("source"), F.lit(iteration).alias("added_iter"), "confidence", F.col("consensus").alias("consensus_score"), F.lit(False).alias("from_known"))


def uncertain(preds: DataFrame, n: int, excluded: DataFrame | None = None) -> DataFrame:
    """The n rows whose probability is closest to one half, for a person to label."""
    if excluded is not None:
        preds = preds.join(excluded.select(F.col("row_index").alias("__x")), F.col("row_index") == F.col("__x"), "left_anti")
    return top(preds.withColumn("uncertainty", F.abs(F.col("p") - 0.5)), n, F.col("uncertainty"), F.col("row_index"))


def for_review(preds: DataFrame, n: int, samples: DataFrame, last_session: DataFrame | None = None, iteration: int = 0, cooldown: int = 10, review_all: bool = True, excluded: DataFrame | None = None) -> DataFrame:
    """(row_index, p, uncertainty, previous_label, previous_source): the n most uncertain rows, for a person to label.

    Left out are `excluded` rows, labelled ones unless `review_all`, and those of the last session
    (iteration, row_index) while it is fewer than `cooldown` iterations ago. What `samples` says of a row comes
    along, so that a verdict against it can be seen as one.
    """
    mine = samples.where(~F.col("from_known"))
    out = [excluded.select("row_index")] if excluded is not None else []
    if not review_all:
        out.append(mine.select("row_index"))
    if last_session is not None and cooldown > 0:
        out.append(last_session.where(F.col("iteration") > iteration - cooldown).select("row_index"))
    gone = reduce(lambda a, b: a.union(b), out) if out else None
    best = uncertain(preds.select("row_index", "p"), n, gone)
    before = mine.groupBy(F.col("row_index").alias("__s")).agg(F.max_by(F.struct("label", "source"), "added_iter").alias("__b"))
    joined = best.join(before, F.col("row_index") == F.col("__s"), "left")
    return joined.select("row_index", "p", "uncertainty", F.col("__b.label").alias("previous_label"), F.col("__b.source").alias("previous_source"))


# --- review ---------------------------------------------------------------------------------------


def removal(t: Thresholds = Thresholds()) -> Column:
    """Why a labelled sample (label, source, p, boot_mean, boot_std) should go; null if it stays. Seeds of positives, forced and expert labels always stay."""
    pos = (F.col("label") == 1) & (F.col("source") == "pseudo_pos")
    neg = (F.col("label") == 0) & (F.col("source") == "pseudo_neg")
    seed = (F.col("label") == 0) & (F.col("source") == "seed")
    return (
        F.when(pos & (F.col("p") < t.pseudo_pos_removal), "probability fell")
        .when(pos & (F.col("boot_std") > t.instability_std) & (F.col("boot_mean") < t.instability_mean), "unstable")
        .when(neg & (F.col("p") > t.pseudo_neg_promotion), "probability rose")
        .when(seed & (F.col("p") > t.seed_neg_removal) & (F.col("boot_mean") > t.seed_neg_removal_mean), "seed looks positive")
    )


def reviewed(samples: DataFrame, preds: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Labelled samples with their present probabilities, the reason to remove them, and survivors' new weights.

    Without an ensemble its mean is the model's probability. A surviving pseudo-positive's weight follows
    how its confidence has changed, up to 1.
    """
    now = preds.withColumns(ensemble_stats()).select("row_index", "p", F.when(F.size("p_boot") > 0, F.col("boot_mean")).otherwise(F.col("p")).alias("boot_mean"), "boot_std")
    df = samples.join(now, "row_index").withColumn("reason", removal(t))
    fresh = F.least(F.lit(1.0), F.col("weight") * F.try_divide((F.col("p") + F.col("boot_mean")) / 2, F.col("confidence")))
    return df.withColumn("weight", F.when(F.col("reason").isNull() & (F.col("source") == "pseudo_pos") & (F.col("confidence") > 0), fresh).otherwise(F.col("weight")))


def class_weight(positive: float, negative: float, t: Thresholds = Thresholds()) -> dict[int, float] | None:
    """Weights by class if the negatives outweigh the positives too far."""
    if not positive or negative / positive <= t.imbalance:
        return None
    return {0: 1.0, 1: negative / positive / t.class_weight_divisor}


# --- bans -----------------------------------------------------------------------------------------


def banned(removed: DataFrame, iteration: int, t: Thresholds = Thresholds()) -> DataFrame:
    return removed.select("row_index", "label", F.lit(iteration + t.ban_iterations).alias("expires_at"))


def merged_bans(bans: DataFrame, more: DataFrame) -> DataFrame:
    """One ban per row and label, the one that lasts longest."""
    return bans.unionByName(more).groupBy("row_index", "label").agg(F.max("expires_at").alias("expires_at"))


def live_bans(bans: DataFrame, iteration: int) -> DataFrame:
    return bans.where(F.col("expires_at") > iteration)


# --- summaries ------------------------------------------------------------------------------------


def enrichment(preds: DataFrame, t: Thresholds = Thresholds(), k: int | None = None) -> DataFrame:
    """(enrichment, expected): the sum of the k highest probabilities, and how many times chance that is. k is at most the table's size."""
    best = top(preds.select("row_index", "p"), t.top_k if k is None else k, F.col("p").desc(), F.col("row_index"))
    return best.agg(F.sum("p").alias("expected"), F.count("*").alias("k")).select(F.try_divide(F.col("expected"), F.col("k") * t.prevalence).alias("enrichment"), "expected")


def probability_histogram(preds: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n) of [0, 1], the last bin closed."""
    return preds.groupBy(F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def threshold_counts(preds: DataFrame, train: DataFrame, cuts: tuple[float, ...] = (0.7, 0.9, 0.99)) -> DataFrame:
    """Rows above each cut, the highest probability, and the highest of rows not trained on: one pass, with a marker joined on."""
    own = preds.join(train.select(F.col("row_index").alias("__t")).distinct(), F.col("row_index") == F.col("__t"), "left")
    return own.agg(*(F.count_if(F.col("p") > c).alias(f"above_{round(c * 100)}") for c in cuts), F.max("p").alias("highest"), F.max(F.when(F.col("__t").isNull(), F.col("p"))).alias("highest_new"))


def removal_extremes(samples: DataFrame) -> DataFrame:
    """The pseudo-positive least likely and the pseudo-negative likeliest to be positive now."""
    pos, neg = F.col("source") == "pseudo_pos", F.col("source") == "pseudo_neg"
    return samples.agg(F.min_by("row_index", F.when(pos, F.struct("p", "row_index"))).alias("worst_pos"), F.min_by("row_index", F.when(neg, F.struct(-F.col("p"), F.col("row_index")))).alias("worst_neg"))
