"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftcurve.session import with_code

SEED = 42
#: Labelled documents taken for training, by label, and the characters taken of each: what bounds the driver's memory. A longer document gives TRAIN_PARTS parts, evenly spread.
TRAIN_ROWS, TRAIN_CHARS, TRAIN_PARTS = 1200, 1 << 15, 8
HELD_OUT_FOLD, FOLDS = 2, 4
WIDTH, EMBED, FILTERS, HIDDEN = 6, 8, 24, 16
#: A chunk has two hops; consecutive chunks overlap by one.
HOP = 128
#: Bytes convolved at a time.
SPAN = HOP * 256
EPOCHS, BATCH, RATE = 14, 32, 0.01
THRESHOLD = 0.7


@dataclass
class Net:
    embed: np.ndarray  # (256, EMBED)
    kernel: np.ndarray  # (WIDTH, EMBED, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    w1: np.ndarray  # (3 * FILTERS, HIDDEN)
    b1: np.ndarray
    w2: np.ndarray  # (HIDDEN,)
    b2: np.ndarray  # (1,)

    def tables(self) -> np.ndarray:
        """For each offset of the window, each byte's contribution to each filter: the convolution as look-ups."""
        return np.einsum("be,wef->wbf", self.embed, self.kernel).astype(np.float32)


def fresh() -> Net:
    rng = np.random.default_rng(SEED)
    n = lambda *shape: rng.normal(size=shape) / np.sqrt(np.prod(shape[:-1]) if len(shape) > 1 else shape[0])
    return Net(rng.normal(size=(256, EMBED)) * 0.5, n(WIDTH, EMBED, FILTERS), np.zeros(FILTERS), n(3 * FILTERS, HIDDEN), np.zeros(HIDDEN), n(HIDDEN), np.zeros(1))


def as_bytes(text: str | None) -> np.ndarray:
    """A text's bytes, followed by zeros for the windows at its end."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass") + bytes(WIDTH), np.uint8)


def hop_maxima(data: np.ndarray, tables: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """The largest filter response in each hop, and where it lies: (hops, FILTERS). Every window of the text is in one."""
    n = len(data) - WIDTH + 1
    tops, at = [], []
    for lo in range(0, n, SPAN):
        hi = min(n, lo + SPAN)
        z = tables[0][data[lo:hi]]
        for j in range(1, WIDTH):
            z += tables[j][data[lo + j : hi + j]]
        starts = np.arange(0, hi - lo, HOP)
        top = np.maximum.reduceat(z, starts, axis=0)
        tops.append(top)
        if where:
            pad = np.pad(z, ((0, len(starts) * HOP - (hi - lo)), (0, 0)), constant_values=-np.inf)
            at.append(pad.reshape(len(starts), HOP, -1).argmax(axis=1) + starts[:, None] + lo)
    return np.concatenate(tops), np.concatenate(at) if where else None


def chunk_maxima(hops: np.ndarray) -> np.ndarray:
    """Overlapping chunks of two hops each."""
    return hops if len(hops) == 1 else np.maximum(hops[:-1], hops[1:])


def features(chunks: np.ndarray) -> np.ndarray:
    """A document by its chunks' pooled responses: their largest, mean and smallest."""
    return np.concatenate([chunks.max(axis=0), chunks.mean(axis=0), chunks.min(axis=0)])


def head(net: Net, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ net.w1 + net.b1)
    return hidden, hidden @ net.w2 + net.b2[0]


def probability(net: Net, tables: np.ndarray, text: str | None) -> float:
    chunks = np.maximum(chunk_maxima(hop_maxima(as_bytes(text), tables)[0]) + net.bias, 0)
    _, z = head(net, features(chunks)[None])
    return float(1 / (1 + np.exp(-np.clip(z[0], -30, 30))))


def backward(net: Net, data: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, callable]:
    """A document's features, and what turns their gradient into the convolution's."""
    hops, at = hop_maxima(data, tables, where=True)
    chunks = chunk_maxima(hops)
    n = np.arange(len(chunks))[:, None]
    side = np.zeros(chunks.shape, int) if len(hops) == 1 else (hops[1:] > hops[:-1]).astype(int)
    place = at[n + side, np.arange(FILTERS)]
    live = np.maximum(chunks + net.bias, 0)

    def apply(g: np.ndarray, grads: dict[str, np.ndarray]) -> None:
        gc = np.repeat(g[None, FILTERS : 2 * FILTERS] / len(chunks), len(chunks), axis=0)
        f = np.arange(FILTERS)
        gc[live.argmax(axis=0), f] += g[:FILTERS]
        gc[live.argmin(axis=0), f] += g[2 * FILTERS :]
        gc *= live > 0
        grads["bias"] += gc.sum(axis=0)
        for j in range(WIDTH):
            byte = data[place + j]
            per = np.zeros((256, FILTERS))
            np.add.at(per, (byte, np.broadcast_to(f, byte.shape)), gc)
            grads["kernel"][j] += net.embed.T @ per
            grads["embed"] += per @ net.kernel[j].T

    return features(live), apply


def train(texts: list[str | None], labels: list[int], prior: float | None = None) -> Net:
    """Adam on the logistic loss, both labels weighing the same; at the end the bias moves to the `prior` share of label 1."""
    net, rng = fresh(), np.random.default_rng(SEED)
    y = np.array(labels, float)
    data = [as_bytes(t) for t in texts]
    if not len(y) or y.min() == y.max():
        share = prior if prior is not None else float(y.mean()) if len(y) else 0.5
        net.w2[:] = 0
        net.b2[0] = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    names = ("embed", "kernel", "bias", "w1", "b1", "w2", "b2")
    first, second, t = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            own = order[lo : lo + BATCH]
            tables = net.tables()
            done = [backward(net, data[i], tables) for i in own]
            x = np.stack([d[0] for d in done])
            hidden, z = head(net, x)
            dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) * weight[own] / len(own)
            dh = np.outer(dz, net.w2) * (1 - hidden**2)
            g = {k: np.zeros_like(getattr(net, k)) for k in names}
            g["w2"], g["b2"], g["w1"], g["b1"] = hidden.T @ dz, np.array([dz.sum()]), x.T @ dh + 1e-4 * net.w1, dh.sum(axis=0)
            for gx, (_, apply) in zip(dh @ net.w1.T, done, strict=True):
                apply(gx, g)
            t += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                setattr(net, k, getattr(net, k) - rate * first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8))
    if prior is not None:
        net.b2 = net.b2 + np.log(np.clip(prior, 0.01, 0.99) / (1 - np.clip(prior, 0.01, 0.99)))
    return net


# --- on tables ------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def training_text(text: Column) -> Column:
    """A text, or the parts of a long one that stand for it in training."""
    n, part = F.length(text), TRAIN_CHARS // TRAIN_PARTS
    parts = [F.substring(text, F.floor((n - part) * k / (TRAIN_PARTS - 1)).cast("int") + 1, F.lit(part)) for k in range(TRAIN_PARTS)]
    return F.when(n > TRAIN_CHARS, F.concat(*parts)).otherwise(text)


def fit(docs: DataFrame, labels: DataFrame) -> Net:
    """Train on at most TRAIN_ROWS documents of either label, none of them held out, the first in a hashed order of ids.

    Defined cases: labels other than 0 and 1, and null ids, are passed over; of labels that disagree on an
    id the larger counts; rows that repeat an id each train; null and empty texts train as texts without
    bytes; without labels, or with one kind only, every score is the labels' share (0.5 without any).
    """
    own = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").where(~held_out(F.col("id")))
    own = own.groupBy("id").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / max(1, sum(counts.values()))
    first = lambda y: own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)
    drawn = F.broadcast(first(0).union(first(1)))  # at most two ids and labels for each of TRAIN_ROWS: few texts move
    known = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), training_text(F.col("text").cast("string")).alias("text"))
    rows = known.join(drawn, F.col("doc_id") == F.col("id")).select("doc_id", "text", "y").orderBy("doc_id", "text").limit(2 * TRAIN_ROWS).collect()
    texts, y = [r["text"] for r in rows], [r["y"] for r in rows]
    return train(texts, y, prior if counts else 0.5)


def score(docs: DataFrame, net: Net, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted): each whole text's probability of label 1.

    Defined cases: null and empty texts get the score of a text without bytes; rows that repeat a
    doc_id each come back; a null doc_id is not held out; an empty table gives an empty one; other
    columns are ignored.
    """
    tables = net.tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([probability(net, tables, b.column(1)[i].as_py()) for i in range(b.num_rows)], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=["doc_id", "score"])

    scored = with_code(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, net: Net, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, whose texts score `threshold` or more.

    Defined cases: null and empty texts are judged like any other, as texts without bytes; repeated rows
    are judged alike; an empty table gives an empty one; other columns pass through, whatever their names.
    """
    tables = net.tables()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([probability(net, tables, b.column(at)[i].as_py()) >= threshold for i in range(b.num_rows)], pa.bool_())
            yield b.filter(keep)

    return with_code(docs).mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all of `documents` by a network trained on `labels`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
