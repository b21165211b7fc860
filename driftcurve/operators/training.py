"""Training and scoring of tabular models, and the decisions that a training loop takes from its history."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftcurve.operators import boosting
from driftcurve.operators.boosting import Boosted, Booster, best_round
from driftcurve.operators.ordering import hashed
from driftcurve.operators.selection import Thresholds

__all__ = ["Booster", "best_round"]


def with_weights(df: DataFrame, label: str, weight: str | None = None, by_class: dict[int, float] | None = None) -> DataFrame:
    """Add `__w`: a sample's weight times its class's."""
    w = F.col(weight) if weight else F.lit(1.0)
    if by_class:
        w = w * F.when(F.col(label) == 1, by_class.get(1, 1.0)).otherwise(by_class.get(0, 1.0))
    return df.withColumn("__w", w.cast("double"))


def inverse_frequency(df: DataFrame, label: str) -> DataFrame:
    """Add `weight` = 1 / rows of the label, for balanced sampling. The counts are one row per label."""
    n = df.groupBy(F.col(label).alias("__l")).agg((1 / F.count("*")).alias("weight"))
    return df.join(n, F.col(label) == F.col("__l")).drop("__l")


def times_drawn(seed: int, key: str = "row_index") -> Column:
    """How often a resample with replacement draws a row: Poisson(1) by the row's hash, so that a retried task draws alike."""
    u = F.conv(F.substring(hashed(seed, key), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
    cumulative, term, times = 0.0, 0.36787944117144233, F.lit(0)
    for k in range(1, 9):
        cumulative += term
        term /= k
        times = F.when(u >= cumulative, k).otherwise(times)
    return times


def bootstrap(df: DataFrame, seed: int, key: str = "row_index") -> DataFrame:
    """A resample with replacement, each row `times_drawn` times."""
    return df.withColumn("__times", times_drawn(seed, key)).where(F.col("__times") > 0).withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__nth")


def hashed_share(seed: int, key: str) -> Column:
    """A number in [0, 1) for each row, by its hash."""
    return F.conv(F.substring(hashed(seed, key), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def train(df: DataFrame, columns: list[str], label: str = "y", weight: str | None = None, by_class: dict[int, float] | None = None, booster: Booster = Booster(), seed: int = 42, key: str = "row_index") -> Boosted:
    """Boosted trees with sample and class weights; a hashed share of the rows validates and decides, in the same fit, on the number of trees."""
    rows = with_weights(df, label, weight, by_class)
    draw = (F.col("__w"), F.lit(1.0), hashed_share(seed, key) < booster.eval_fraction)
    return boosting.fit(rows, columns, F.col(label), [draw], booster, [seed], key)[0]


def train_members(df: DataFrame, columns: list[str], drawn: list[int], seeds: list[int], label: str = "y", weight: str | None = None, by_class: list[dict[int, float] | None] | None = None, booster: Booster = Booster(), key: str = "row_index") -> list[Boosted]:
    """One model for each seed in `drawn`, on the resample that `bootstrap` draws with it, all in the same passes: a resample is a weight of rows, not a table."""
    draws = []
    for k, (d, s) in enumerate(zip(drawn, seeds, strict=True)):
        w = F.col(weight) if weight else F.lit(1.0)
        if by_class and by_class[k]:
            w = w * F.when(F.col(label) == 1, by_class[k].get(1, 1.0)).otherwise(by_class[k].get(0, 1.0))
        draws.append((w, times_drawn(d, key), hashed_share(s, key) < booster.eval_fraction))
    return boosting.fit(df, columns, F.col(label), draws, booster, seeds, key) if draws else []


def predict(model: Boosted, df: DataFrame, name: str = "p") -> DataFrame:
    """Add the probability of the positive class, partition by partition."""
    return boosting.predict([model], df, [name])


def predict_members(models: list[Boosted], df: DataFrame, names: list[str]) -> DataFrame:
    """Add the probability of each model, in one pass."""
    return boosting.predict(models, df, names) if models else df


def importances(model: Boosted, columns: list[str], df: DataFrame) -> DataFrame:
    """(feature, importance), the highest first: shares of all gains."""
    return df.sparkSession.createDataFrame([(c, float(x)) for c, x in zip(columns, model.gains(), strict=True)], "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def train_network(df: DataFrame, columns: list[str], label: str = "y", hidden: tuple[int, ...] = (32, 16), rounds: int = 100, seed: int = 42, mode: str = "features_only") -> PipelineModel:
    """A perceptron on standardised features, trained on the cluster; for modes with sequences see `networks`."""
    if mode != "features_only":
        raise ValueError(f"{mode}: sequences are for driftcurve.operators.networks")
    stages = [VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="keep"), StandardScaler(inputCol="__v", outputCol="__x", withMean=True), MultilayerPerceptronClassifier(featuresCol="__x", labelCol=label, layers=[len(columns), *hidden, 2], maxIter=rounds, seed=seed)]
    return Pipeline(stages=stages).fit(df.withColumn(label, F.col(label).cast("double")))


# --- decisions ------------------------------------------------------------------------------------


def tightened(t: Thresholds) -> Thresholds:
    return replace(t, pseudo_pos=min(t.highest_pos, t.pseudo_pos + t.tighten_pos), pseudo_neg=max(t.lowest_neg, t.pseudo_neg - t.tighten_neg), max_pseudo_pos=max(t.min_pseudo_pos, t.max_pseudo_pos - t.tighten_max_pos))


def adjusted(t: Thresholds, successful: int, last_pos: int, last_neg: int) -> Thresholds:
    """Relaxed at every 20th successful iteration where the last one added nothing; tightened while there is none."""
    if successful == 0:
        return tightened(t)
    if successful % t.relax_every:
        return t
    if last_pos == 0:
        t = replace(t, pseudo_pos=max(t.min_pseudo_pos_threshold, t.pseudo_pos - t.relax_pos), max_pseudo_pos=min(t.max_pseudo_pos_cap, t.max_pseudo_pos + t.relax_max_pos))
    if last_neg == 0:
        t = replace(t, pseudo_neg=min(t.max_pseudo_neg_threshold, t.pseudo_neg + t.relax_neg))
    return t


def must_roll_back(ice: float, last_ice: float, tracked_pos: tuple[float, float] | None = None, tracked_neg: tuple[float, float] | None = None, rise: float = 0.5, move: float = 0.9) -> bool:
    """Whether calibration got worse by more than `rise` since the last iteration, or a tracked row's probability (before, now) moved the wrong way by more than `move`."""
    if ice > last_ice + rise:
        return True
    if tracked_pos and tracked_pos[0] - tracked_pos[1] > move:
        return True
    return bool(tracked_neg and tracked_neg[1] - tracked_neg[0] > move)


def tracked_error(pos: float | None, neg: float | None) -> float | None:
    """How far tracked rows are from what they should be, on average; None without any."""
    errors = ([1 - pos] if pos is not None else []) + ([neg] if neg is not None else [])
    return sum(errors) / len(errors) if errors else None


def model_score(ice: float, error: float | None = None, weight: float = 0.01) -> float:
    """Lower is better. Without tracked rows it is the calibration error alone."""
    return ice if error is None else ice * (1 - weight) + error * weight


@dataclass(frozen=True)
class Targets:
    """What a run must reach to be a success."""

    recall: float = 1.0
    precision: float = 1.0
    enrichment: float = 999.0
    successful: int = 50


def succeeded(recall: float, precision: float, enrichment: float, successful: int, targets: Targets = Targets()) -> bool:
    """Whether validation, the last known enrichment and the iterations since the last rollback reach all targets."""
    return recall >= targets.recall and precision >= targets.precision and enrichment >= targets.enrichment and successful >= targets.successful


def plateau(history: DataFrame, run: str = "run", window: int = 20, recall_range: float = 0.01, ice_range: float = 0.01, least_ice: int = 5, quiet: int = 5) -> DataFrame:
    """(run, stopped): over the last 20 rows of a run recall and calibration hardly moved, and the last 5 added no positives."""
    back = F.row_number().over(W.partitionBy(run).orderBy(F.col("iteration").desc())) - 1
    h = history.withColumn("__b", back)
    late = F.col("__b") < window
    r, i = F.when(late, F.col("recall")), F.when(late & (F.col("ice") > 0), F.col("ice"))
    rule = (F.count("*") >= window) & (F.max(r) - F.min(r) < recall_range) & (F.count(i) >= least_ice) & (F.max(i) - F.min(i) < ice_range) & (F.sum(F.when(F.col("__b") < quiet, F.col("pseudo_pos_added"))) == 0)
    return h.groupBy(run).agg(rule.alias("stopped"))


def stop_reason(history: list[dict], started_hours_ago: float, max_hours: float = 24.0, target_ice: float = 0.0, max_iterations: int = 100, rollbacks: list[int] | None = None, window: int = 20) -> str | None:
    """TIME_LIMIT, ICE, PLATEAU, MAX_ITERATIONS or UNSTABLE, in that order, from a run's metric rows."""
    if started_hours_ago >= max_hours:
        return "TIME_LIMIT"
    if history and history[-1]["ice"] <= target_ice:
        return "ICE"
    tail = history[-window:]
    if len(tail) == window:
        recall, ice = [h["recall"] for h in tail], [h["ice"] for h in tail if h["ice"] > 0]
        if max(recall) - min(recall) < 0.01 and len(ice) >= 5 and max(ice) - min(ice) < 0.01 and not sum(h["pseudo_pos_added"] for h in tail[-5:]):
            return "PLATEAU"
    if len(history) >= max_iterations:
        return "MAX_ITERATIONS"
    if rollbacks and len([i for i in rollbacks if i > len(history) - 10]) > 10:
        return "UNSTABLE"
    return None
