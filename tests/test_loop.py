"""The loop on a small pool: rows near one corner are positive."""

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from driftcurve.operators import loop, selection as sel, splits, training as tr

SMALL = loop.Config(train_neg=60, validation_neg=60, held_out_neg=30, train_pos=0.4, validation_pos=0.3, max_iterations=2, booster=tr.Booster(rounds=5, depth=3))


@pytest.fixture(scope="module")
def rows(spark):
    noise = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0)
    pool = spark.range(600).select(F.col("id").alias("row_index"), (noise(1) + F.when(F.col("id") % 20 == 0, 1.0).otherwise(0.0)).alias("a"), noise(2).alias("b"))
    known = spark.range(40).select(F.col("id").alias("row_index"), (1.0 + noise(3)).alias("a"), noise(4).alias("b"))
    return pool.cache(), known.cache()


def history(result):
    names = [f.split()[0] for f in loop.HISTORY.split(", ")]
    return [dict(zip(names, h, strict=True)) for h in result["history"]]


def test_defaults_match_the_documented_ones():
    assert sel.Thresholds().class_weight_divisor == 1.0 and not loop.Config().use_weights and loop.Config().cooldown == 10 and loop.Config().review_all


def test_pseudo_labels_tracked_rows_and_members(spark, rows):
    low = rows[0].where("row_index % 20 <> 0").agg(F.min_by("row_index", "a")).first()[0]
    high = rows[0].where("row_index % 20 = 0").agg(F.max_by("row_index", "a")).first()[0]
    run = loop.SelfTraining(spark, *rows, ["a", "b"], replace(SMALL, members=2, tracked_positive=high, tracked_negative=low, thresholds=sel.Thresholds(pseudo_neg=0.45, neg_consensus_low=0.45)))
    result = run.run()
    h = history(result)
    assert result["reason"] == "MAX_ITERATIONS" and len(h) == 2
    roles = {(r.from_known, r.row_index): (r.role, r.label) for r in result["roles"].collect()}
    assert roles[False, high] == ("validation", 1) and roles[False, low] == ("validation", 0)
    assert h[0]["tracked_pos"] > h[0]["tracked_neg"] and 0 <= h[0]["oob_recall"] <= 1 and 0.5 < h[0]["oob_coverage"] < 1 and h[0]["oob_diverged"] in (True, False)
    assert h[0]["expert_pos_added"] == h[0]["expert_neg_added"] == 0 and h[0]["pseudo_pos_added"] + h[0]["pseudo_neg_added"] > 0
    apart = {i for (k, i), (role, _) in roles.items() if not k and role != "train"}
    assert not apart & {r.row_index for r in result["samples"].where(~F.col("from_known")).collect()}


def test_expert_mode_asks_merges_cools_down_and_finishes(spark, rows):
    asked = []

    def ask(candidates, k):
        got = candidates.collect()
        asked.append(got)
        verdicts = [(r.row_index, int(r.row_index % 20 == 0)) for r in got[:6]]
        return spark.createDataFrame(verdicts, "row_index bigint, label int"), k == 2

    small = replace(SMALL, max_iterations=9, thresholds=sel.Thresholds(max_pseudo_pos=12))
    result = loop.SelfTraining(spark, *rows, ["a", "b"], small, ask=ask).run()
    h = history(result)
    assert result["reason"] == "EXPERT_FINISH" and len(h) == 2 and len(asked) == 2
    assert all(x["pseudo_pos_added"] == x["pseudo_neg_added"] == 0 for x in h)
    first, second = ([r.row_index for r in a] for a in asked)
    assert len(first) == 12 and not set(first[:6]) & set(second)  # they rest
    assert [r.uncertainty for r in asked[0]] == sorted(r.uncertainty for r in asked[0])
    said = {i: int(i % 20 == 0) for i in first[:6] + second[:6]}
    apart = {r.row_index for r in result["roles"].where(~F.col("from_known") & (F.col("role") != "train")).collect()}
    assert not apart & set(said)
    samples = {r.row_index: r for r in result["samples"].where(~F.col("from_known")).collect()}
    assert all(samples[i].label == y for i, y in said.items())
    new = [i for i in said if samples[i].source.startswith("expert")]
    assert h[0]["expert_pos_added"] + h[0]["expert_neg_added"] + h[1]["expert_pos_added"] + h[1]["expert_neg_added"] == len(new)


def test_candidates_for_review(spark):
    preds = spark.createDataFrame([(i, 0.5 + 0.01 * i) for i in range(10)], "row_index bigint, p double")
    samples = spark.createDataFrame([(1, 0, 1.0, "seed", 0, 1.0, 1.0, False), (2, 1, 1.0, "pseudo_pos", 3, 1.0, 1.0, False), (3, 1, 1.0, "seed", 0, 1.0, 1.0, True)], "row_index bigint, label int, weight double, source string, added_iter int, confidence double, consensus_score double, from_known boolean")
    last = spark.createDataFrame([(4, 0)], "iteration int, row_index bigint")
    ids = lambda df: [r.row_index for r in df.orderBy("uncertainty").collect()]
    assert ids(sel.for_review(preds, 3, samples)) == [0, 1, 2]
    assert ids(sel.for_review(preds, 3, samples, last, 13)) == [1, 2, 3] and ids(sel.for_review(preds, 3, samples, last, 14)) == [0, 1, 2]
    assert ids(sel.for_review(preds, 3, samples, last, 13, cooldown=0)) == [0, 1, 2]
    assert ids(sel.for_review(preds, 3, samples, last, 13, review_all=False)) == [3, 4, 5]
    said = {r.row_index: (r.previous_label, r.previous_source) for r in sel.for_review(preds, 4, samples).collect()}
    assert said == {0: (None, None), 1: (0, "seed"), 2: (1, "pseudo_pos"), 3: (None, None)}


def test_success_and_rollback(spark, rows, monkeypatch):
    easy = replace(SMALL, max_iterations=5, targets=tr.Targets(0.0, 0.0, 0.0, 2))
    result = loop.SelfTraining(spark, *rows, ["a", "b"], easy).run()
    assert result["reason"] == "SUCCESS" and len(result["history"]) == 1
    run = loop.SelfTraining(spark, *rows, ["a", "b"], replace(SMALL, max_iterations=3))
    real, calls = run.evaluate, []

    def worse(model, role):
        calls.append(role)
        return real(model, role) | ({"ice": 0.05} if len(calls) != 2 else {"ice": 0.9})

    monkeypatch.setattr(run, "evaluate", worse)
    result = run.run()
    assert run.rollbacks == [2] and [h["iteration"] for h in history(result)] == [1, 3] and history(result)[1]["rollbacks"] == 1
    assert run.t.pseudo_pos >= SMALL.thresholds.pseudo_pos and result["bans"].count() >= 0


def test_output_folder(spark, rows, tmp_path):
    out = f"file://{tmp_path}/out"
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "report_now").write_text("")
    run = loop.SelfTraining(spark, *rows, ["a", "b"], replace(SMALL, output=out, report_every=2, thresholds=sel.Thresholds(top_k=7)))
    result = run.run()
    assert not (tmp_path / "out" / "report_now").exists()
    for k in (1, 2):  # the first was asked for, the second is due
        part = f"iter={k:03d}"
        p = [r.p for r in spark.read.parquet(f"{out}/probabilities/{part}").collect()]
        assert len(p) == 600 and p == sorted(p, reverse=True)
        assert spark.read.parquet(f"{out}/top_candidates/{part}").count() == 7 and spark.read.parquet(f"{out}/histograms/{part}").agg(F.sum("n")).first()[0] == 600
        assert spark.read.json(f"{out}/metrics/{part}").first().iteration == k and spark.read.parquet(f"{out}/importances/{part}").count() == 2
        assert spark.read.parquet(f"{out}/labelled/{part}").count() > 0
    run.save(f"{out}/end", result)
    assert json.loads(spark.read.text(f"{out}/end/held_out").first().value).keys() >= {"recall", "ice"} and spark.read.parquet(f"{out}/end/samples").count() > 0


def test_asking_by_files(spark, tmp_path):
    ask = loop.ask_by_files(spark, str(tmp_path), patience=0.0, pause=0.01)
    candidates = spark.createDataFrame([(1, 0.5)], "row_index bigint, p double")
    verdicts, finish = ask(candidates, 1)
    assert verdicts.count() == 0 and not finish and spark.read.parquet(f"{tmp_path}/uncertain/iter=001").count() == 1
    (tmp_path / "verdicts" / "iter=002").mkdir(parents=True)
    (tmp_path / "verdicts" / "iter=002" / "log.jsonl").write_text('{"iteration": 2, "pos": [1], "neg": [5, 6]}\n')
    (tmp_path / "finish").write_text("")
    verdicts, finish = ask(candidates, 2)
    assert sorted(map(tuple, verdicts.collect())) == [(1, 1), (5, 0), (6, 0)] and finish


def test_roles_must_be_disjoint(spark):
    roles = spark.createDataFrame([(1, "train"), (2, "validation"), (2, "train")], "row_index bigint, role string")
    with pytest.raises(ValueError):
        splits.assert_disjoint(roles)
    splits.assert_disjoint(roles.where("row_index = 1"))
    assert [r.row_index for r in splits.overlapping(roles).collect()] == [2]


def test_boosting_separates_and_stops_at_the_best_round(spark, rows):
    pool, known = rows
    df = pool.where("row_index % 20 <> 0").withColumn("y", F.lit(0)).unionByName(known.withColumn("y", F.lit(1)).withColumn("row_index", F.col("row_index") + 10_000))
    model = tr.train(df, ["a", "b"], booster=tr.Booster(rounds=8, depth=3))
    right = tr.predict(model, df).agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double"))).first()[0]
    assert right > 0.97
    assert tr.best_round([5, 4, 3, 3.5, 2], 2) == 5 and tr.best_round([5, 4, 3, 3.5, 3.4, 2], 2) == 3 and tr.best_round([1.0], 250) == 1
    one = tr.train(df.where("y = 1"), ["a", "b"], booster=tr.Booster(rounds=2))  # one label alone
    assert tr.predict(one, df).count() == df.count()


def test_gathers_do_not_shuffle_the_pool(spark, rows):
    run = loop.SelfTraining(spark, *rows, ["a", "b"], replace(SMALL, pool_buckets=3))
    wanted = spark.range(40).select(F.col("id").alias("row_index"), F.lit(False).alias("from_known"), F.lit(0).alias("label"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = run.features(wanted)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    lines = plan.split("\n")
    scan = next(i for i, line in enumerate(lines) if "FileScan" in line and ".pool_" in line)
    sort = max(i for i in range(scan) if "- Sort " in lines[i])
    assert "Bucketed: true" in lines[scan] and "SortMergeJoin" in plan and not any("Exchange" in line for line in lines[sort:scan])
