import numpy as np
import pytest
from pyspark.sql import functions as F

from driftcurve.operators import networks as N


def data(n=160, seed=0):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 2
    seqs = [np.stack([rng.normal(size=m) + (2 * k - 1) * np.linspace(0, 2, m), rng.normal(size=m)], axis=1) for k, m in zip(y, rng.integers(5, 16, n), strict=True)]
    return seqs, rng.normal(size=(n, 3)) + y[:, None] * 0.8, y


@pytest.mark.parametrize("cell", N.CELLS)
@pytest.mark.parametrize("pooling", N.POOLING)
def test_gradients_equal_differences(cell, pooling):
    seqs, feats, y = data(6)
    m = N.SequenceModel(N.Settings(cell=cell, pooling=pooling, hidden=4, columns=("a", "b", "c"), epochs=0, head=(5,))).fit(seqs, feats, y)
    w = {k: N.Node(v) for k, v in m.weights.items()}
    out = m.logits(w, seqs, feats)
    N.Node(np.zeros(()), ((out, lambda _: np.ones_like(out.data)),)).backward()
    total = lambda: m.logits({k: N.Node(v) for k, v in m.weights.items()}, seqs, feats).data.sum()
    for k, v in m.weights.items():
        at = tuple(0 for _ in v.shape)
        old, eps = v[at], 1e-5
        v[at] = old + eps
        up = total()
        v[at] = old - eps
        down = total()
        v[at] = old
        grad = 0.0 if w[k].grad is None else w[k].grad[at]
        assert grad == pytest.approx((up - down) / (2 * eps), abs=1e-4), k


@pytest.mark.parametrize(("mode", "cell"), [("sequence_only", c) for c in N.CELLS] + [("hybrid", "gru"), ("features_only", "rnn")])
def test_learns_and_ignores_padding(mode, cell):
    seqs, feats, y = data()
    m = N.SequenceModel(N.Settings(mode=mode, cell=cell, hidden=8, columns=() if mode == "sequence_only" else ("a", "b", "c"), epochs=12)).fit(seqs[:120], feats[:120], y[:120])
    p = m.probabilities(seqs[120:], feats[120:])
    assert ((p > 0.5) == y[120:]).mean() > 0.7
    alone = np.array([m.probabilities([s], f[None])[0] for s, f in zip(seqs[120:130], feats[120:130], strict=True)])
    assert np.allclose(alone, p[:10], atol=1e-9)
    back = N.SequenceModel.from_json(m.to_json())
    assert np.allclose(back.probabilities(seqs[120:], feats[120:]), p, atol=1e-12)


def test_tables(spark, tmp_path):
    seqs, feats, y = data(60)
    rows = [(i, s.tolist() if i else None, *map(float, f), int(k)) for i, (s, f, k) in enumerate(zip(seqs, feats, y, strict=True))]
    df = spark.createDataFrame(rows, "row_index int, sequence array<array<double>>, a double, b double, c double, class int").withColumn("b", F.when(F.col("row_index") == 3, F.lit(float("nan"))).otherwise(F.col("b")))
    m = N.train(df, N.Settings(hidden=4, columns=("a", "b", "c"), epochs=2))
    got = N.predict(m, df).collect()
    assert len(got) == 60 and all(0 <= r.p <= 1 for r in got)
    N.save(spark, m, f"{tmp_path}/m")
    again = {r.row_index: r.p for r in N.predict(N.load(spark, f"{tmp_path}/m"), df.repartition(3)).collect()}
    assert all(again[r.row_index] == pytest.approx(r.p, abs=1e-9) for r in got)


def test_predictions_are_kept_for_the_same_model_and_rows(spark, tmp_path, monkeypatch):
    seqs, feats, y = data(20)
    df = spark.createDataFrame([(i, s.tolist(), *map(float, f), int(k)) for i, (s, f, k) in enumerate(zip(seqs, feats, y, strict=True))], "row_index int, sequence array<array<double>>, a double, b double, c double, class int")
    m = N.train(df, N.Settings(hidden=4, columns=("a", "b", "c"), epochs=1))
    calls, real = [], N.predict
    monkeypatch.setattr(N, "predict", lambda *a: calls.append(1) or real(*a))
    first = sorted(map(tuple, N.predict_cached(m, df, str(tmp_path)).collect()))
    assert sorted(map(tuple, N.predict_cached(m, df.repartition(5), str(tmp_path)).collect())) == first and len(calls) == 1
    assert N.predict_cached(m, df.where("row_index < 9"), str(tmp_path)).count() == 9 and len(calls) == 2
    other = N.SequenceModel.from_json(m.to_json())
    other.weights[next(iter(other.weights))] += 0.5
    N.predict_cached(other, df, str(tmp_path))
    assert len(calls) == 3


@pytest.mark.parametrize("wrong", [{"mode": "other"}, {"cell": "cnn"}, {"mode": "hybrid", "columns": ()}, {"hidden": 5, "columns": ("a",)}])
def test_settings_are_checked(wrong):
    with pytest.raises(ValueError):
        N.Settings(**wrong)


@pytest.mark.parametrize("cell", ["gru", "transformer"])
def test_training_on_tables_equals_one_process(spark, cell):
    """All rows count, in mini-batches that several tasks share; losses, weights and probabilities are those of a single process."""
    seqs, feats, y = data(150, seed=3)
    rows = [(i, s.tolist(), *map(float, f), int(k), 1.0 + i % 3) for i, (s, f, k) in enumerate(zip(seqs, feats, y, strict=True))]
    df = spark.createDataFrame(rows, "row_index int, sequence array<array<double>>, a double, b double, c double, class int, u double").repartition(5)
    s = N.Settings(cell=cell, hidden=4, head=(6,), columns=("a", "b", "c"), epochs=3, batch=64)
    losses = []
    got = N.train(df, s, weight="u", report=lambda k, v: losses.append(v))
    batch = {r.row_index: r.b for r in df.select("row_index", N.batch_of(s, "row_index", 3).alias("b")).collect()}
    alone = []
    want = N.SequenceModel(s).fit(seqs, feats, y, np.array([1.0 + i % 3 for i in range(150)]), lambda k, v: alone.append(v), np.array([batch[i] for i in range(150)]))
    assert losses == pytest.approx(alone, abs=1e-6) and losses[-1] < losses[0]
    for k, v in want.weights.items():
        assert np.allclose(got.weights[k], v, atol=1e-6), k
    assert np.allclose(got.probabilities(seqs, feats), want.probabilities(seqs, feats), atol=1e-6)


def test_driver_gets_sums_alone(spark, monkeypatch):
    """What comes to the driver is as long as the weights, however many rows there are."""
    seen, real = [], N.summed_gradient

    def watched(model, rows, weigh):
        n, loss, grad = real(model, rows, weigh)
        seen.append((n, sum(v.size for v in grad.values())))
        return n, loss, grad

    monkeypatch.setattr(N, "summed_gradient", watched)
    monkeypatch.setattr(N.DataFrame, "toArrow", lambda *_: pytest.fail("rows in the driver"), raising=False)
    s = N.Settings(mode="features_only", columns=("a",), head=(4,), epochs=1, batch=500)
    for n in (300, 3000):
        seen.clear()
        m = N.train(spark.range(n).selectExpr("id AS row_index", "CAST(id % 7 AS DOUBLE) AS a", "CAST(id % 7 > 3 AS INT) AS class"), s)
        assert sum(k for k, _ in seen) == n and {size for _, size in seen} == {sum(v.size for v in m.weights.values())}


@pytest.mark.parametrize(("cell", "pooling"), [("gru", "attention"), ("lstm", "last")])
def test_small_mini_batches_are_taken_in_runs(spark, monkeypatch, cell, pooling):
    """Jobs do not grow with the number of mini-batches, and runs that hand the weights on give what one process gives."""
    seqs, feats, y = data(150, seed=4)
    rows = [(i, s.tolist(), *map(float, f), int(k)) for i, (s, f, k) in enumerate(zip(seqs, feats, y, strict=True))]
    df = spark.createDataFrame(rows, "row_index int, sequence array<array<double>>, a double, b double, c double, class int").repartition(5)
    s = N.Settings(cell=cell, pooling=pooling, hidden=4, head=(6,), columns=("a", "b", "c"), epochs=2, batch=4)
    monkeypatch.setattr(N, "RUN", 48, raising=False)  # four runs an epoch
    spark.sparkContext.setJobGroup("runs", "runs")
    losses = []
    got = N.train(df, s, report=lambda k, v: losses.append(v))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("runs"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 60  # there are 76 mini-batches
    batch = np.array([r.b for r in df.select("row_index", N.batch_of(s, "row_index", 38).alias("b")).orderBy("row_index").collect()])
    alone = []
    want = N.SequenceModel(s).fit(seqs, feats, y, None, lambda k, v: alone.append(v), batch)
    assert losses == pytest.approx(alone, abs=1e-6)
    for k, v in want.weights.items():
        assert np.allclose(got.weights[k], v, atol=1e-6), k


def test_arrays_of_cut_and_missing_sequences():
    rows = [[[1.0, 2.0]], None, [], [[3.0, None], [float("inf"), 6.0]], [[7.0, float("nan")]]]
    want = [[[1, 2]], [[0, 0]], [[0, 0]], [[3, 0], [1e6, 6]], [[7, 0]]]
    column = N.pa.array(rows, N.pa.list_(N.pa.list_(N.pa.float64())))
    for lo in range(6):
        for n in range(6 - lo):
            got = N.arrays_of(column.slice(lo, n), 2)
            assert [x.tolist() for x in got] == want[lo : lo + n]
    assert [x.tolist() for x in N.arrays_of(N.pa.nulls(2, column.type), 3)] == [[[0, 0, 0]]] * 2
    with pytest.raises(ValueError, match="channels"):
        N.arrays_of(N.pa.array([[[1.0], [1.0, 2.0]]]), 1)


@pytest.mark.parametrize("cell", ["rnn", "gru", "lstm"])
def test_layers_of_layers_have_right_gradients(cell):
    """Two layers, so gradients pass through a layer to the one below, and a long sequence among short ones."""
    seqs, feats, y = data(5, seed=2)
    m = N.SequenceModel(N.Settings(mode="sequence_only", cell=cell, pooling="last", layers=2, hidden=4, epochs=0)).fit([*seqs[:4], np.tile(seqs[4], (3, 1))], feats, y)
    sample = np.arange(1.0, 6.0)
    loss = lambda: m.gradient(seqs, feats, y, sample)[0]
    _, grad = m.gradient(seqs, feats, y, sample)
    for k, v in m.weights.items():
        at = tuple(n // 2 for n in v.shape)
        old, eps = v[at], 1e-5
        v[at] = old + eps
        up = loss()
        v[at] = old - eps
        down = loss()
        v[at] = old
        assert grad[k][at] == pytest.approx((up - down) / (2 * eps), abs=1e-4), k
