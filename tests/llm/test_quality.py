import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftcurve.llm import quality as Q

DOCS = "doc_id bigint, text string, lang string, score string"
LABELS = "doc_id bigint, quality int, toxic int"


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(60)]
        out.append(" ".join(w + rng.choice(["%%%", "$$$", "&&&"]) for w in words) if i % 3 == 0 else " ".join(words))
    return out, [int(i % 3 != 0) for i in range(n)]


def test_look_ups_equal_the_convolution():
    net = Q.fresh()
    data = Q.as_bytes("Größe " * 700)
    hops, _ = Q.hop_maxima(data, net.tables())
    z = np.stack([sum(net.embed[data[i + j]] @ net.kernel[j] for j in range(Q.WIDTH)) for i in range(len(data) - Q.WIDTH + 1)])
    plain = np.stack([z[a : a + Q.HOP].max(axis=0) for a in range(0, len(z), Q.HOP)])
    assert np.allclose(hops, plain, atol=1e-4)


def test_gradients_equal_differences():
    net = Q.fresh()
    data = Q.as_bytes("some words, and others! " * 30)
    x, apply = Q.backward(net, data, net.tables())
    g = np.random.default_rng(1).normal(size=x.shape)
    grads = {k: np.zeros_like(getattr(net, k)) for k in ("embed", "kernel", "bias")}
    apply(g, grads)
    for name, at in (("kernel", (2, 3, 4)), ("embed", (ord("o"), 2)), ("bias", (5,))):
        own = getattr(net, name)
        eps, old = 1e-3, own[at]
        own[at] = old + eps
        up = Q.backward(net, data, net.tables())[0] @ g
        own[at] = old - eps
        down = Q.backward(net, data, net.tables())[0] @ g
        own[at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.05, abs=0.02)


def test_held_out_accuracy(spark):
    t, y = texts(900)
    docs = spark.createDataFrame([(i, x, None, "s") for i, x in enumerate(t)], DOCS)
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(y)], LABELS)
    got = Q.score(docs, Q.fit(docs, labels)).toPandas().set_index("doc_id").sort_index()
    assert got.held_out.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(900)]
    assert got.score.between(0, 1).all() and ((got.score >= 0.7).astype(int) == got.predicted).all()
    own = got[got.held_out]
    assert (own.predicted == np.array(y)[own.index]).mean() > 0.95


def test_labels_of_held_out_rows_are_not_used(spark):
    t, y = texts(300)
    docs = spark.createDataFrame([(i, x, None, "s") for i, x in enumerate(t)], DOCS)
    flipped = [1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q for i, q in enumerate(y)]
    a, b = (Q.fit(docs, spark.createDataFrame([(i, q, 0) for i, q in enumerate(v)], LABELS)) for v in (y, flipped))
    assert np.array_equal(a.w1, b.w1)


def test_edge_cases(spark):
    t, y = texts(60)
    docs = spark.createDataFrame([(i, x, None, "s") for i, x in enumerate(t)], DOCS)
    net = Q.fit(docs, spark.createDataFrame([(i, q, 0) for i, q in enumerate(y)] + [(None, 1, 1), (3, None, 0), (7, 1, 0), (7, 1, 0)], LABELS))
    rows = [(1, None, None, None), (1, "", None, None), (None, "a", None, None), (2, "word " * 300_000, None, None), (2, "x", None, None)]
    got = Q.score(spark.createDataFrame(rows, DOCS), net).collect()
    assert len(got) == 5 and len({r.score for r in got if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], DOCS)
    assert Q.score(empty, Q.fit(empty, spark.createDataFrame([], LABELS))).count() == 0
    kept = Q.accepted(docs, net)
    assert kept.columns == docs.columns and kept.count() == Q.score(docs, net).where("predicted = 1").count()


def test_long_documents_train_by_parts(spark):
    text = "".join(f"{i:07d} " for i in range(20_000))
    got = spark.createDataFrame([(text,), ("short",), (None,)], "t string").select(Q.training_text(F.col("t")).alias("t")).collect()
    n, part = len(text), Q.TRAIN_CHARS // Q.TRAIN_PARTS
    assert got[0].t == "".join(text[(n - part) * k // (Q.TRAIN_PARTS - 1) :][:part] for k in range(Q.TRAIN_PARTS)) and got[0].t.endswith(text[-part:])
    assert got[1].t == "short" and got[2].t is None


def test_query_scores_equal_the_plain_network(spark):
    """All of the smallest table: each row's score from its whole text by the definition of the convolution."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = Q.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in Q.op5_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in sorted(rows, key=lambda r: len(r.text or ""))[::9]:
        data = np.concatenate([np.frombuffer((r.text or "").encode(), np.uint8), np.zeros(Q.WIDTH, np.uint8)])
        z = np.stack([sum(net.embed[data[i + j]] @ net.kernel[j] for j in range(Q.WIDTH)) for i in range(len(data) - Q.WIDTH + 1)])
        hops = [z[i : i + Q.HOP].max(axis=0) for i in range(0, len(z), Q.HOP)]
        chunks = np.maximum(np.stack([np.maximum(a, b) for a, b in zip(hops, hops[1:])] or hops) + net.bias, 0)
        x = np.concatenate([chunks.max(axis=0), chunks.mean(axis=0), chunks.min(axis=0)])
        p = 1 / (1 + np.exp(-(np.tanh(x @ net.w1 + net.b1) @ net.w2 + net.b2[0])))
        assert got[r.doc_id].score == pytest.approx(p, abs=2e-3)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)
