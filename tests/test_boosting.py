"""Boosted trees against a plain booster on arrays."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftcurve.operators import boosting as B, training as tr


def plain(x, y, w, booster, edges):
    """Level by level, node by node, on all rows at once: the margins after each round."""
    codes = B.coded(x, edges)
    margin = np.zeros(len(y))
    out = []
    for _ in range(booster.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        step = np.zeros(len(y))

        def split(rows, depth):
            best = (1e-12, None)
            if depth < booster.depth:
                for c in range(x.shape[1]):
                    for t in range(booster.bins + 1):
                        left = rows[codes[rows, c] <= t]
                        right = rows[codes[rows, c] > t]
                        if min(len(left), len(right)) < booster.leaf_rows:
                            continue
                        s = lambda r: g[r].sum() ** 2 / (h[r].sum() + booster.l2)
                        gain = s(left) + s(right) - s(rows)
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
            if best[1] is None:
                step[rows] = -g[rows].sum() / (h[rows].sum() + booster.l2) * booster.rate
            else:
                for part in best[1]:
                    split(part, depth + 1)

        split(np.arange(len(y)), 0)
        margin = margin + step
        out.append(margin)
    return out


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x[rng.random(400) < 0.1, 1] = np.nan
    y = (x[:, 0] + 0.5 * np.nan_to_num(x[:, 1]) ** 2 + 0.3 * rng.normal(size=400) > 0.4).astype(int)
    w = rng.uniform(0.5, 2.0, 400)
    rows = [(i, *map(float, v), int(k), float(u)) for i, (v, k, u) in enumerate(zip(x, y, w, strict=True))]
    return x, y, w, spark.createDataFrame(rows, "row_index bigint, a double, b double, c double, y int, u double").repartition(5).cache()


@pytest.mark.parametrize("booster", [B.Booster(rounds=10, depth=3, bins=8, eval_fraction=0.0), B.Booster(rounds=2, depth=2, bins=16, eval_fraction=0.0, l2=50.0, leaf_rows=40)])
def test_equals_a_plain_booster(data, booster):
    x, y, w, df = data
    model = tr.train(df, ["a", "b", "c"], weight="u", booster=booster)
    want = 1 / (1 + np.exp(-plain(x, y, w, booster, model.edges)[-1]))
    got = {r.row_index: r.p for r in tr.predict(model, df).collect()}
    assert len(model.trees) == booster.rounds and np.allclose([got[i] for i in range(400)], want, atol=1e-8)
    assert np.allclose(model.probabilities(x), want, atol=1e-8)


def test_trees_do_not_depend_on_partitions(data, monkeypatch):
    *_, df = data
    booster = B.Booster(rounds=2, depth=3, bins=16, subsample=0.7)
    one = tr.train(df, ["a", "b", "c"], booster=booster)
    monkeypatch.setattr(B, "TASK_BYTES", 4000)
    monkeypatch.setattr(B, "CHUNK", 2)
    two = tr.train(df.repartition(3, "c"), ["a", "b", "c"], booster=booster)
    assert one.to_json() == two.to_json()


def test_penalty_shrinks_leaves(data):
    *_, df = data
    largest = [max(np.abs(t.value).max() for t in tr.train(df, ["a", "b"], booster=B.Booster(rounds=1, depth=2, bins=16, l2=v)).trees) for v in (0.0, 3.0, 300.0)]
    assert largest[0] > largest[1] > 3 * largest[2] > 0


def test_one_fit_stops_at_the_best_validation_loss(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(v), int(rng.random() < 0.5)) for i, v in enumerate(rng.normal(size=200))]  # nothing to learn
    df = spark.createDataFrame(rows, "row_index bigint, a double, y int")
    booster = B.Booster(rounds=12, depth=3, bins=32, rate=0.5, l2=0.0, patience=3)
    model = tr.train(df, ["a"], booster=booster)
    best = B.best_round(model.losses, 3)
    assert len(model.trees) == best < 12 and len(model.losses) - best == 3 and model.losses[best - 1] == min(model.losses)
    apart = {r.row_index for r in df.where(tr.hashed_share(42, "row_index") < 0.2).collect()}
    own = np.array([[v] for i, v, _ in rows if i in apart])
    y = np.array([k for i, _, k in rows if i in apart])
    p = model.probabilities(own)
    assert -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) == pytest.approx(model.losses[best - 1], abs=1e-9)


def test_members_equal_models_on_resamples_and_share_passes(data):
    *_, df = data
    booster = B.Booster(rounds=4, depth=3, bins=16)
    began = time.perf_counter()
    tr.train(df, ["a", "b", "c"], booster=booster)
    single = time.perf_counter() - began
    began = time.perf_counter()
    together = tr.train_members(df, ["a", "b", "c"], [11, 12, 13, 14, 15], [1, 2, 3, 4, 5], booster=booster)
    assert time.perf_counter() - began < 2 * single + 2
    table = df.select("*")
    for k in (0, 3):
        # the resample as a table, with the cuts of all rows
        alone = B.fit(table, ["a", "b", "c"], F.col("y"), [(F.lit(1.0), tr.times_drawn(11 + k), tr.hashed_share(1 + k, "row_index") < 0.2)], booster, [1 + k], "row_index")[0]
        assert alone.to_json() == together[k].to_json()
    drawn = tr.bootstrap(df, 11).count()
    assert together[0].to_json() != together[1].to_json() and drawn > 0
    scored = tr.predict_members(together, df, [f"p{k}" for k in range(5)])
    assert scored.columns[-5:] == [f"p{k}" for k in range(5)] and scored.where("p0 <> p1").count() > 100


def test_saved_models_and_gains(spark, data, tmp_path):
    x, *_, df = data
    model = tr.train(df, ["a", "b", "c"], booster=B.Booster(rounds=3, depth=3, bins=16))
    model.save(spark, f"{tmp_path}/m")
    assert np.array_equal(B.load(spark, f"{tmp_path}/m").probabilities(x), model.probabilities(x))
    gains = {r.feature: r.importance for r in tr.importances(model, ["a", "b", "c"], df).collect()}
    assert sum(gains.values()) == pytest.approx(1.0) and gains["a"] > gains["b"] > gains["c"]


def test_odd_tables(spark, data):
    *_, df = data
    same = df.withColumn("y", F.lit(1))
    one = tr.train(same, ["a"], booster=B.Booster(rounds=2, depth=2))
    assert tr.predict(one, df).agg(F.min("p")).first()[0] > 0.55
    blank = df.withColumn("a", F.lit(None).cast("double"))
    assert len({r.p for r in tr.predict(tr.train(blank, ["a"], booster=B.Booster(rounds=2, depth=2)), blank).collect()}) == 1
    with pytest.raises(ValueError):
        B.Booster(bins=1000)
