import pytest
from pyspark.sql import functions as F

from driftcurve.operators import labels as lab, metrics as met, ranking, selection as sel, splits, training as tr


def test_ensemble_statistics(spark):
    rows = [(0, [0.1, 0.2, 0.15]), (1, [0.9, 0.8, 0.85]), (2, [0.5, 0.6, 0.55]), (3, []), (4, [0.1, 0.9, 0.5])]
    got = {r.row_index: r for r in spark.createDataFrame(rows, "row_index int, p_boot array<double>").withColumns(sel.ensemble_stats()).collect()}
    assert got[0].boot_mean == pytest.approx(0.15) and got[1].boot_mean == pytest.approx(0.85) and got[2].consensus == pytest.approx(1 - got[2].boot_std)
    assert (got[3].boot_mean, got[3].boot_std, got[3].consensus) == (0, 0, 1) and got[4].consensus < 0.7


def test_curriculum_phases(spark):
    df = spark.createDataFrame([(0.96,), (0.95,), (0.86,), (0.71,), (0.70,)], "c double")
    got = [[r[0] for r in df.select(sel.curriculum(F.col("c"), recall)).collect()] for recall in (0.4, 0.5, 0.65)]
    assert got == [[1, 0, 0, 0, 0], [1, 0.7, 0.7, 0, 0], [1, 0.95, 0.86, 0.71, 0]]


def test_bans_apply_after_the_top_k(spark):
    preds = spark.createDataFrame([(i, 0.001 * i, []) for i in range(5)], "row_index int, p double, p_boot array<double>")
    bans = spark.createDataFrame([(0, 0, 9), (1, 0, 3)], "row_index int, label int, expires_at int")
    t = sel.Thresholds(max_pseudo_neg=3)
    got = sel.pseudo_negatives(preds, preds.where("row_index = 4"), bans, 3, t)
    assert sorted(r.row_index for r in got.collect()) == [1, 2]


def test_labels_resolve_merge_and_unite(spark):
    votes = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 1), (2, 0), (3, 0), (3, 0), (4, 1)], "row_index int, label int")
    assert {(r.row_index, r.label) for r in lab.resolve_expert(votes).collect()} == {(1, 1), (3, 0), (4, 1)}
    a, b = spark.createDataFrame([(1,), (2,)], "row_index int"), spark.createDataFrame([(2,), (3,)], "row_index int")
    assert {(r.row_index, r.label) for r in lab.reconciled(a, b).collect()} == {(1, 1), (2, 1), (3, 0)}
    pool = spark.createDataFrame([(i, float(i)) for i in range(5)], "row_index int, x double")
    known = spark.createDataFrame([(7.0,), (8.0,)], "z double")
    got = lab.labelled_set(pool, known, {"forced": a}, {"forced": b, "expert": b})
    assert sorted((r["class"], r.source, r._dataset) for r in got.collect()) == [(0, "expert", "pool"), (1, "forced", "pool"), (1, "forced", "pool"), (1, "known", "known"), (1, "known", "known")]
    with pytest.raises(ValueError):
        lab.labelled_set(pool, None, {}, {})


def test_splits_are_disjoint_sized_and_stable(spark):
    df = spark.createDataFrame([(i, float(i % 17), i % 50) for i in range(100)], "row_index int, norm_amplitude_sigma double, npoints int")
    count = lambda d: {r.role: r.n for r in d.groupBy("role").agg(F.count("*").alias("n")).collect()}
    got = splits.random_split(df, 0.1, 0.4)
    assert count(got) == {"train": 10, "validation": 40, "held_out": 50}
    again = splits.random_split(df.repartition(3), 0.1, 0.4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))
    some = splits.stratified_split(df, exclude=df.limit(0).union(df.where("row_index < 5")))
    assert some.count() == 95 and some.where("row_index < 5").count() == 0
    assert count(splits.stratified_split(df.drop("norm_amplitude_sigma", "npoints"))) == {"train": 10, "validation": 40, "held_out": 50}
    assert "held_out" not in count(splits.stratified_split(df.drop("norm_amplitude_sigma", "npoints"), 0.1, 0.4, held_out=0))


def test_metrics(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.3, 1), (0.1, 0), (0.8, 1)], "p double, y int")
    r = met.confusion(df).first()
    assert (r.recall, r.precision) == (pytest.approx(2 / 3), pytest.approx(2 / 3))
    assert met.ranking_areas(df).first().auc == pytest.approx((2 + 1.5 + 1) / 6)
    empty = met.confusion(df.limit(0)).first()
    assert (empty.recall, empty.precision, empty.f1) == (0, 0, 0)


def test_threshold_and_stopping_rules():
    t = sel.Thresholds()
    assert tr.adjusted(t, 20, 0, 5).pseudo_pos == pytest.approx(0.945) and tr.adjusted(t, 20, 0, 5).max_pseudo_pos == 101 and tr.adjusted(t, 19, 0, 0) == t
    assert tr.tightened(t).pseudo_pos == pytest.approx(0.96) and tr.tightened(t).max_pseudo_pos == 97
    assert tr.must_roll_back(0.61, 0.1) and not tr.must_roll_back(0.6, 0.1) and tr.must_roll_back(0.1, 0.1, (0.99, 0.05)) and tr.must_roll_back(0.1, 0.1, None, (0.0, 0.95)) and not tr.must_roll_back(0.1, 0.1, (0.05, 0.99), (0.95, 0.0))
    assert tr.model_score(0.1) == 0.1 and tr.model_score(0.1, tr.tracked_error(0.8, 0.4)) == pytest.approx(0.1 * 0.99 + 0.3 * 0.01)
    assert tr.tracked_error(None, None) is None and tr.tracked_error(0.8, None) == pytest.approx(0.2) and tr.tracked_error(None, 0.4) == 0.4
    assert tr.succeeded(1.0, 1.0, 999.0, 50) and not any(tr.succeeded(*x) for x in ((0.99, 1.0, 999.0, 50), (1.0, 0.99, 999.0, 50), (1.0, 1.0, 998.0, 50), (1.0, 1.0, 999.0, 49)))
    assert tr.stop_reason([{"recall": 0.5, "ice": 0.3, "pseudo_pos_added": 1}] * 12, 0, rollbacks=list(range(3, 14))) == "UNSTABLE"
    flat = [{"recall": 0.9, "ice": 0.05, "pseudo_pos_added": 0}] * 20
    assert tr.stop_reason(flat, 0) == "PLATEAU" and tr.stop_reason(flat[:19], 0) is None and tr.stop_reason([], 30) == "TIME_LIMIT" and tr.stop_reason(flat[:3], 0, max_iterations=3) == "MAX_ITERATIONS" and tr.stop_reason(flat, 0, target_ice=0.06) == "ICE"
    assert sel.pseudo_weight(1, 3) == pytest.approx(0.35) and sel.pseudo_weight(0, 9) == 1 and sel.class_weight(1, 100) == {0: 1.0, 1: 100.0} and sel.class_weight(10, 100) is None


def test_warm_up_and_features(spark):
    names = [f"norm_wv_{i}" for i in range(3)] + [f"f{i}" for i in range(10)]
    assert lab.warm_up(names, 0) == names[:3] and len(lab.warm_up(names, 40)) == 5
    with pytest.raises(ValueError):
        lab.warm_up(["a"], 0)
    df = spark.createDataFrame([(1, "s", 1.0, True, float("inf"), None)], "row_index int, source string, a double, b boolean, c double, d double")
    assert lab.feature_columns(df) == ["a", "b", "c", "d"]
    assert tuple(lab.matrix_rows(df.drop("b"), ["a", "c", "d"]).first())[2:] == (1.0, 1e6, 0.0)


def test_bootstrap_is_a_resample(spark):
    got = tr.bootstrap(spark.range(4000).withColumnRenamed("id", "row_index"), 1)
    n, distinct = got.count(), got.distinct().count()
    assert abs(n - 4000) < 250 and abs(distinct / 4000 - 0.632) < 0.03 and got.count() == n


def test_ranking_orders_by_difference(spark):
    pop = spark.createDataFrame([(float(i), float(i % 3) - 5) for i in range(50)], "a double, b double")
    rare = spark.createDataFrame([(100.0 + i, float(i % 3) - 5) for i in range(9)], "a double, b double")
    got = ranking.rank_features(pop, rare, ["a", "b"]).collect()
    assert [r.feature for r in got] == ["a", "b"] and got[0].cohens_d_mean > 3 and got[1].mean_ratio > 0
    with pytest.raises(ValueError):
        ranking.rank_features(pop, rare, [])


def test_ranks_equal_a_global_sort(spark):
    from driftcurve.operators.ordering import hash_ranked, hashed

    df = spark.range(3000).select(F.col("id").alias("row_index"), (F.col("id") % 3).alias("g"))
    got = hash_ranked(df, 4, ("row_index",), F.col("g")).withColumn("h", hashed(4, "row_index")).collect()
    for g in range(3):
        own = sorted((r.h, r.row_index) for r in got if r.g == g)
        ranks = {r.row_index: r["__rank"] for r in got if r.g == g}
        assert [ranks[i] for _, i in own] == list(range(1, 1001)) and {r["__n"] for r in got} == {1000}
    assert sel.sample(df, 5, 1, per="g").groupBy("g").count().where("count = 5").count() == 3


def test_places_equal_a_global_sort_whatever_the_spread(spark):
    from driftcurve.operators.ordering import placed

    for p in ("0.0", "CASE WHEN id % 50 = 0 THEN rand(3) ELSE 0.0001 END", "rand(4)", "CASE WHEN id % 7 = 0 THEN NULL ELSE id % 5 END"):
        df = spark.range(3000).selectExpr("id AS row_index", f"CAST({p} AS DOUBLE) AS p").cache()
        got = placed(df, "p", "row_index").collect()
        want = sorted(df.collect(), key=lambda r: (r.p is None, -(r.p or 0), r.row_index))
        assert {r.row_index: r.place for r in got} == {r.row_index: i + 1 for i, r in enumerate(want)}


def test_medians_without_a_columns_values_in_one_place(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(float(a), float(int(b * 3)), None if i % 3 else float(c), None) for i, (a, b, c) in enumerate(rng.normal(size=(5001, 3)))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = {r.feature: r["median"] for r in ranking.exact_medians(df, ["a", "b", "c", "d"], 50).collect()}
    assert got == {x: pytest.approx(np.median([r[i] for r in rows if r[i] is not None])) for i, x in enumerate("abc")}
    even = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "a double")
    assert ranking.exact_medians(even, ["a"]).first()["median"] == 3.0


def test_many_quantiles_of_many_columns_and_groups(spark):
    import numpy as np

    from driftcurve.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    rows = [(str(i % 3) if i % 11 else None, float(a), float(int(3 * b)), float("nan") if i % 5 == 0 else float(c), None) for i, (a, b, c) in enumerate(rng.normal(size=(4000, 3)))]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, d double").repartition(4)
    qs = (0.0, 0.05, 0.2, 0.5, 0.77, 1.0)
    found, first = exact_quantiles(df, ["a", "b", "c", "d"], qs, "g", accuracy=60, also=[F.count("*").alias("rows")])
    got = {(r["grp"], r["feature"], r["q"]): r["value"] for r in found.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for k, c in enumerate("abc", 1):
            own = [r[k] for r in rows if r[0] == g and r[k] == r[k]]
            want |= {(g, c, q): pytest.approx(np.quantile(own, q)) for q in qs}
    assert got == want and sum(r["rows"] for r in first) == 4000
    assert exact_quantiles(df.limit(0), ["a"], (0.5,))[0].count() == 0


def test_split_has_no_percentile_in_one_task(spark):
    df = spark.range(500).selectExpr("id AS row_index", "CAST(id * 7919 % 501 AS DOUBLE) AS norm_amplitude_sigma", "id % 40 AS npoints")
    got = splits.stratified_split(df)
    plan = got._jdf.queryExecution().toString()
    assert "percentile(" not in plan and {r["role"]: r["count"] for r in got.groupBy("role").count().collect()}.keys() == {"train", "validation", "held_out"}


def test_areas_equal_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    for p in (rng.random(700) * 1e-5, np.round(rng.random(700), 1), np.full(700, 0.25)):
        y = (rng.random(700) < 0.1 + 0.5 * p / p.max()).astype(int)
        df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int").repartition(3)
        got = met.ranking_areas(df).first()
        one, zero = p[y == 1][:, None], p[y == 0][None, :]
        assert got.auc == pytest.approx(((one > zero) + 0.5 * (one == zero)).mean())
        at = [((p >= a) & (y == 1)).sum() / (p >= a).sum() for a in p[y == 1]]
        assert got.pr_auc == pytest.approx(np.mean(at))
    assert tuple(met.ranking_areas(df.limit(0)).first()) == (0.5, 0.0)
