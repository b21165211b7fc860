"""Self-training: a model proposes labels, itself or through a person, learns from them, and takes back what it no longer believes.

State is kept in tables: each iteration writes its labelled samples and bans and reads them back, so
plans stay short and a lost executor costs a task. The driver holds scalars only.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from driftcurve.operators import labels as lab, metrics as met, selection as sel, splits, training as tr
from driftcurve.operators.ordering import hash_ranked
from driftcurve.sources import state, tables

HISTORY = (
    "iteration int, recall double, precision double, f1 double, auc double, pr_auc double, logloss double, brier double, ice double, pseudo_pos_added bigint, pseudo_neg_added bigint, "
    "expert_pos_added bigint, expert_neg_added bigint, removed bigint, n_pos bigint, n_neg bigint, enrichment double, expected double, pos_threshold double, neg_threshold double, "
    "oob_recall double, oob_precision double, oob_coverage double, oob_diverged boolean, tracked_pos double, tracked_neg double, successful int, rollbacks int, elapsed_hours double"
)

#: Asks a person: from a table of candidates (see selection.for_review) and the iteration to verdicts (row_index, label) and whether to finish.
Ask = Callable[[DataFrame, int], tuple[DataFrame, bool]]


@dataclass(frozen=True)
class Config:
    """Sizes and limits; numbers below 1 for positives are shares. `tracked_*` are rows of the pool that validation watches."""

    train_pos: float = 0.1
    validation_pos: float = 0.4
    train_neg: int = 35_000
    validation_neg: int = 75_000
    held_out_neg: int = 10_000
    members: int = 0
    booster: tr.Booster = field(default_factory=tr.Booster)
    max_iterations: int = 50
    max_hours: float = 24.0
    target_ice: float = 0.0
    targets: tr.Targets = field(default_factory=tr.Targets)
    seed: int = 42
    use_weights: bool = False
    warm_up: str | None = None
    ice_rise: float = 0.5
    tracked_move: float = 0.9
    tracked_weight: float = 0.01
    tracked_positive: int | None = None
    tracked_negative: int | None = None
    oob_divergence: float = 0.15
    enrichment_every: int = 5
    report_every: int = 50
    cooldown: int = 10
    review_all: bool = True
    output: str | None = None
    pool_buckets: int | None = None  # as many as shuffle partitions
    thresholds: sel.Thresholds = field(default_factory=sel.Thresholds)


class SelfTraining:
    """`pool` and `known` have row_index and feature columns; `expert` are verdicts (row_index, label) on pool rows.

    With `ask`, the run is in expert mode: each iteration emits the most uncertain rows, waits for verdicts and
    merges them, and adds no pseudo-labels. Without it the model labels the rows it is sure of.
    """

    def __init__(self, spark: SparkSession, pool: DataFrame, known: DataFrame, columns: list[str], config: Config = Config(), expert: DataFrame | None = None, ask: Ask | None = None):
        self.spark, self.known, self.columns, self.config, self.expert, self.ask = spark, known, columns, config, expert, ask
        self.store = state.Store(spark, "self-training")
        # each iteration gathers rows from the pool: it is dealt out by row once, and only what is wanted moves
        self.pool = self.store.bucketed(pool.select("row_index", *columns), "pool", "row_index", config.pool_buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.history: list[dict] = []
        self.rollbacks: list[int] = []
        self.t = config.thresholds
        self.successful = 0
        self.last_session: DataFrame | None = None

    @property
    def tracked(self) -> dict[int, int]:
        c = self.config
        return {i: y for i, y in ((c.tracked_positive, 1), (c.tracked_negative, 0)) if i is not None}

    def split(self) -> None:
        """Roles of rows: seeds, validation and held-out; tracked rows validate for good and are never trained on."""
        c = self.config
        known = splits.stratified_split(self.known, c.train_pos, c.validation_pos, c.seed)
        roles = known.select(F.lit(True).alias("from_known"), "row_index", F.lit(1).alias("label"), "role")
        need = c.train_neg + c.validation_neg + c.held_out_neg
        free = self.pool.select("row_index").where(~F.col("row_index").isin(list(self.tracked))) if self.tracked else self.pool.select("row_index")
        drawn = self.store.table(sel.sample(free, need, c.seed), "drawn")
        if drawn.count() < need:
            raise ValueError(f"the pool has fewer than {need} rows")
        rank = F.col("__rank")
        role = F.when(rank <= c.train_neg, "train").when(rank <= c.train_neg + c.validation_neg, "validation").otherwise("held_out")
        negatives = hash_ranked(drawn, c.seed, ("row_index",)).withColumn("role", role).select(F.lit(False).alias("from_known"), "row_index", F.lit(0).alias("label"), "role")
        watched = self.spark.createDataFrame([(False, i, y, "validation") for i, y in self.tracked.items()], "from_known boolean, row_index bigint, label int, role string")
        self.roles = self.store.table(roles.unionByName(negatives).unionByName(watched), "roles")
        splits.assert_disjoint(self.roles, ("from_known", "row_index"))
        seeds = self.roles.where("role = 'train'").select("row_index", "label", F.lit(1.0).alias("weight"), F.lit("seed").alias("source"), F.lit(0).alias("added_iter"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("consensus_score"), "from_known")
        if self.expert is not None:
            seeds = lab.merge_expert(seeds, self.judged(lab.resolve_expert(self.expert)), 0)
        self.samples = self.store.table(seeds, "samples-0")
        self.bans = self.spark.createDataFrame([], "row_index bigint, label int, expires_at int")

    def kept_apart(self) -> DataFrame:
        """Pool rows of validation and the held-out set: no verdict or pseudo-label brings them into training."""
        return self.roles.where(~F.col("from_known") & (F.col("role") != "train")).select("row_index")

    def judged(self, verdicts: DataFrame) -> DataFrame:
        """Verdicts on rows that may be trained on."""
        return verdicts.join(self.kept_apart().withColumnRenamed("row_index", "__a"), F.col("row_index") == F.col("__a"), "left_anti")

    def features(self, rows: DataFrame) -> DataFrame:
        """Rows (row_index, from_known, ...) with their features, from whichever table they are in."""
        pool = self.pool.select(F.col("row_index").alias("__i"), *self.columns)
        known = self.known.select(F.col("row_index").alias("__i"), *self.columns)
        parts = [rows.where(F.col("from_known") == k).join(t, F.col("row_index") == F.col("__i")).drop("__i") for k, t in ((False, pool), (True, known))]
        return parts[0].unionByName(parts[1])

    def active_columns(self) -> list[str]:
        return lab.warm_up(self.columns, self.successful, self.config.warm_up) if self.config.warm_up else self.columns

    def class_weights(self, sums: dict[int, float]) -> dict[int, float] | None:
        return sel.class_weight(sums.get(1, 0.0), sums.get(0, 0.0), self.t) if self.config.use_weights else None

    def fit(self, samples: DataFrame, seed: int):
        c = self.config
        sums = {r["label"]: r["w"] for r in samples.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
        return tr.train(self.features(samples), self.active_columns(), "label", "weight" if c.use_weights else None, self.class_weights(sums), c.booster, seed)

    def fit_members(self, samples: DataFrame, drawn: list[int]) -> list:
        """Models on resamples, all grown in the same passes over the samples' features."""
        c = self.config
        if not drawn:
            return []
        sums = samples.groupBy("label").agg(*(F.sum(F.col("weight") * tr.times_drawn(s)).alias(str(k)) for k, s in enumerate(drawn))).collect()
        by_class = [self.class_weights({r["label"]: r[str(k)] for r in sums}) for k in range(len(drawn))]
        return tr.train_members(self.features(samples), self.active_columns(), drawn, [c.seed + m for m in range(len(drawn))], "label", "weight" if c.use_weights else None, by_class, c.booster)

    def evaluate(self, model, role: str) -> dict[str, float]:
        rows = self.features(self.roles.where(F.col("role") == role))
        scored = self.store.table(tr.predict(model, rows).select("p", F.col("label").alias("y")), f"scored-{role}")
        first = met.confusion(scored).first()
        if not first["n"]:
            return dict(met.NO_MODEL)
        return {**first.asDict(), **met.ranking_areas(scored).first().asDict()}

    def tracked_probabilities(self, model) -> tuple[float | None, float | None]:
        """The present probabilities of the tracked rows, at most two."""
        if not self.tracked:
            return None, None
        rows = tr.predict(model, self.pool.where(F.col("row_index").isin(list(self.tracked))).select("row_index", *self.columns)).select("row_index", "p")
        p = {r["row_index"]: r["p"] for r in rows.collect()}
        return p.get(self.config.tracked_positive), p.get(self.config.tracked_negative)

    def predictions(self, model, members: list) -> DataFrame:
        """The pool's probabilities by the model and its members, from one pass."""
        names = ["p", *(f"__p{k}" for k in range(len(members)))]
        scored = tr.predict_members([model, *members], self.pool.select("row_index", *self.columns), names)
        boot = F.array(*(F.col(f"__p{k}") for k in range(len(members)))) if members else F.array().cast("array<double>")
        return scored.select("row_index", "p", boot.alias("p_boot"))

    def out_of_bag(self, members: list, samples: DataFrame, seeds: list[int]) -> dict[str, float]:
        """Scores of the labelled samples by the members that did not train on them, from one pass over their features."""
        scored = tr.predict_members(members, self.features(samples), [f"__p{k}" for k in range(len(members))])
        free = [F.when(tr.times_drawn(s) == 0, F.col(f"__p{k}")) for k, s in enumerate(seeds)]
        known = F.array_compact(F.array(*free))
        mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
        return met.out_of_bag_means(scored.select(mean.alias("p"), F.col("label").alias("y"))).first().asDict()

    def ask_expert(self, preds: DataFrame, k: int) -> tuple[dict[int, int], bool]:
        """A session with a person: candidates out, verdicts in, merged into the samples. How many of either label came in, and whether to finish."""
        c = self.config
        found = sel.for_review(preds, self.t.max_pseudo_pos, self.samples, self.last_session, k, c.cooldown, c.review_all, self.kept_apart())
        found = self.store.table(found, f"uncertain-{k}")
        if found.isEmpty():
            return {}, False
        verdicts, finish = self.ask(found, k)
        verdicts = self.store.table(self.judged(lab.resolve_expert(verdicts)).withColumn("iteration", F.lit(k)), f"verdicts-{k}")
        self.last_session = verdicts.select("iteration", "row_index")
        self.samples = self.store.table(lab.merge_expert(self.samples, verdicts.select("row_index", "label"), k).select(*sel.SAMPLE_COLUMNS), f"asked-{k}")
        new = self.samples.where((F.col("added_iter") == k) & F.col("source").startswith("expert"))
        return {r["label"]: r["n"] for r in new.groupBy("label").agg(F.count("*").alias("n")).collect()}, finish

    def pseudo_labels(self, preds: DataFrame, k: int) -> DataFrame:
        excluded = self.samples.where(~F.col("from_known")).select("row_index").union(self.roles.where(~F.col("from_known")).select("row_index"))
        neg = sel.pseudo_negatives(preds, excluded, self.bans, k, self.t, successful=self.successful, seed=self.config.seed + k)
        pos = sel.pseudo_positives(preds, excluded, self.bans, k, self.t, successful=self.successful)
        return self.store.table(neg.unionByName(pos), f"added-{k}")

    def roll_back(self, k: int) -> None:
        """What was added since the best state is banned for a while; that state comes back under stricter rules."""
        since = self.samples.where((F.col("added_iter") >= self.best["iteration"]) & F.col("source").startswith("pseudo"))
        self.bans = self.store.table(sel.merged_bans(self.bans, sel.banned(since, k, self.t)), f"bans-back-{k}")
        self.model, self.samples, self.t = self.best["model"], self.best["samples"], tr.tightened(self.best["thresholds"])
        self.successful = 0
        self.rollbacks.append(k)

    def validated(self, k: int) -> tuple[dict[str, float], str]:
        """The model's scores, and what follows from them: back, on, or success."""
        c = self.config
        scores = self.evaluate(self.model, "validation")
        pos, neg = self.tracked_probabilities(self.model)
        before = self.before
        moved = lambda a, b: (a, b) if a is not None and b is not None else None
        back = before is not None and tr.must_roll_back(scores["ice"], before[0], moved(before[1], pos), moved(before[2], neg), c.ice_rise, c.tracked_move)
        if back and self.best:
            self.roll_back(k)
            self.before = (self.evaluate(self.model, "validation")["ice"], *self.tracked_probabilities(self.model))
            return scores, "back"
        self.successful += 1
        score = tr.model_score(scores["ice"], tr.tracked_error(pos, neg), c.tracked_weight)
        if not self.best or score < self.best["score"]:
            self.best = {"model": self.model, "score": score, "samples": self.samples, "thresholds": self.t, "iteration": k}
        rich = self.history[-1]["enrichment"] if self.history else 0.0
        return scores, "success" if tr.succeeded(scores["recall"], scores["precision"], rich, self.successful, c.targets) else "on"

    def run(self) -> dict:
        c, began = self.config, time.time()
        hours = lambda: (time.time() - began) / 3600
        self.split()
        self.model = self.fit(self.samples, c.seed)
        self.best: dict = {}
        self.before: tuple | None = None
        reason = None
        for k in range(1, c.max_iterations + 1):
            self.bans = sel.live_bans(self.bans, k)
            scores, then = self.validated(k)
            if then == "success":
                reason = "SUCCESS"
                break
            if then == "back":
                reason = tr.stop_reason(self.history, hours(), c.max_hours, -1.0, c.max_iterations + 1, self.rollbacks)
                if reason in ("TIME_LIMIT", "UNSTABLE"):
                    break
                continue
            seeds = [c.seed + 1000 * k + m for m in range(c.members)]
            drawn_from = self.samples
            members = self.fit_members(drawn_from, seeds)
            preds = self.store.table(self.predictions(self.model, members), f"preds-{k}")
            finish, asked, counts = False, {}, {}
            if self.ask:
                asked, finish = self.ask_expert(preds, k)
                more = self.samples.limit(0).select(*sel.SAMPLE_COLUMNS)
            else:
                more = self.pseudo_labels(preds, k).select(*sel.SAMPLE_COLUMNS)
                counts = {r["label"]: r["n"] for r in more.groupBy("label").agg(F.count("*").alias("n")).collect()}
            rich = self.history[-1] if self.history else {"enrichment": 0.0, "expected": 0.0}
            if k == 1 or (c.enrichment_every and k % c.enrichment_every == 0):
                rich = sel.enrichment(preds, self.t).first().asDict()
            gone = self.review(preds, more, k)
            sizes = {r["label"]: r["n"] for r in self.samples.groupBy("label").agg(F.count("*").alias("n")).collect()}
            self.model = self.fit(self.samples, c.seed + len(self.history))
            oob = self.out_of_bag(members, drawn_from, seeds) if members else {"oob_recall": None, "oob_precision": None, "coverage": None}
            pos, neg = self.tracked_probabilities(self.model)
            row = {
                "iteration": k, **{m: float(scores[m]) for m in met.NO_MODEL}, "pseudo_pos_added": counts.get(1, 0), "pseudo_neg_added": counts.get(0, 0),
                "expert_pos_added": asked.get(1, 0), "expert_neg_added": asked.get(0, 0), "removed": gone, "n_pos": sizes.get(1, 0), "n_neg": sizes.get(0, 0),
                "enrichment": float(rich["enrichment"] or 0.0), "expected": float(rich["expected"] or 0.0), "pos_threshold": self.t.pseudo_pos, "neg_threshold": self.t.pseudo_neg,
                "oob_recall": oob["oob_recall"], "oob_precision": oob["oob_precision"], "oob_coverage": oob["coverage"],
                "oob_diverged": None if oob["oob_recall"] is None else abs(oob["oob_recall"] - scores["recall"]) > c.oob_divergence,
                "tracked_pos": pos, "tracked_neg": neg, "successful": self.successful, "rollbacks": sum(i > k - 10 for i in self.rollbacks), "elapsed_hours": hours(),
            }
            self.history.append(row)
            self.before = (scores["ice"], pos, neg)
            self.t = tr.adjusted(self.t, self.successful, row["pseudo_pos_added"], row["pseudo_neg_added"])
            self.written(preds, k)
            reason = tr.stop_reason(self.history, hours(), c.max_hours, c.target_ice, c.max_iterations, self.rollbacks)
            if not reason and finish:
                reason = "EXPERT_FINISH"
            if reason:
                break
        best = self.best["model"] if self.best else self.model
        names = [f.split()[0] for f in HISTORY.split(", ")]
        return {
            "model": best, "last_model": self.model, "reason": reason or "MAX_ITERATIONS", "samples": self.samples, "bans": self.bans, "roles": self.roles, "history": [tuple(h[n] for n in names) for h in self.history],
            "held_out": self.evaluate(best, "held_out"), "predictions": self.predictions(best, []).select("row_index", "p").orderBy(F.col("p").desc(), "row_index"),
        }

    def review(self, preds: DataFrame, more: DataFrame, k: int) -> int:
        """Take out the samples that the model no longer believes, ban them, refresh weights and add `more`; how many went."""
        of_known = self.samples.where("from_known").select(*sel.SAMPLE_COLUMNS)
        checked = self.store.table(sel.reviewed(self.samples.where(~F.col("from_known")), preds, self.t), f"checked-{k}")
        gone = checked.where("reason IS NOT NULL")
        self.bans = self.store.table(sel.merged_bans(self.bans, sel.banned(gone, k, self.t)), f"bans-{k}")
        stay = checked.where("reason IS NULL").select(*sel.SAMPLE_COLUMNS)
        self.samples = self.store.table(of_known.unionByName(stay).unionByName(more), f"samples-{k}")
        return gone.count()

    def written(self, preds: DataFrame, k: int) -> None:
        """Under the output folder, if there is one: each iteration's metrics, histogram, top candidates and importances; every so often,
        or where a file `report_now` asks for it, all probabilities, the likeliest first, and the labelled samples."""
        c, out = self.config, self.config.output
        if not out:
            return
        part = f"iter={k:03d}"
        save = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}/{part}")
        names = [f.split()[0] for f in HISTORY.split(", ")]
        self.spark.createDataFrame([tuple(self.history[-1][n] for n in names)], HISTORY).coalesce(1).write.mode("overwrite").json(f"{out}/metrics/{part}")
        save(sel.probability_histogram(preds), "histograms")
        save(sel.top(preds.select("row_index", "p"), self.t.top_k, F.col("p").desc(), F.col("row_index")), "top_candidates")
        save(tr.importances(self.model, self.active_columns(), preds), "importances")
        asked = tables.exists(self.spark, f"{out}/report_now")
        if asked or (c.report_every and k % c.report_every == 0):
            save(preds.select("row_index", "p").orderBy(F.col("p").desc(), "row_index"), "probabilities")
            save(self.samples, "labelled")
            if asked:
                tables.remove(self.spark, f"{out}/report_now")

    def save(self, folder: str, result: dict) -> None:
        """Models (the best and the last), labelled samples, all probabilities (the likeliest first), metrics and settings under a folder."""
        result["model"].save(self.spark, f"{folder}/model")
        result["last_model"].save(self.spark, f"{folder}/last_model")
        result["samples"].write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/samples")
        result["predictions"].write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/probabilities")
        self.spark.createDataFrame(result["history"], HISTORY).coalesce(1).write.mode("overwrite").json(f"{folder}/history")
        one_line = lambda x, name: self.spark.createDataFrame([(json.dumps(x),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
        one_line(result["held_out"], "held_out")
        one_line({"config": asdict(self.config), "reason": result["reason"], "held_out": result["held_out"]}, "settings")


def ask_by_files(spark: SparkSession, folder: str, patience: float = 3600.0, pause: float = 5.0) -> Ask:
    """Ask through a folder that a labelling tool watches.

    Each session writes its candidates to `uncertain/iter=NNN`; the tool answers with a label log in
    `verdicts/iter=NNN` (JSON lines with pos and neg) and, to end the run, a file `finish`. A session without
    an answer within `patience` seconds brings no verdicts.
    """

    def ask(candidates: DataFrame, k: int) -> tuple[DataFrame, bool]:
        candidates.write.mode("overwrite").parquet(f"{folder}/uncertain/iter={k:03d}")
        answer, until = f"{folder}/verdicts/iter={k:03d}", time.time() + patience
        while not tables.exists(spark, answer) and time.time() < until:
            time.sleep(pause)
        there = tables.exists(spark, answer)
        verdicts = tables.read_label_log(spark, answer).select("row_index", "label") if there else spark.createDataFrame([], "row_index bigint, label int")
        return verdicts, tables.exists(spark, f"{folder}/finish")

    return ask
