"""Gradient-boosted trees from histograms: Newton steps with a penalty on leaves, any number of models in the same passes.

Columns are cut into bins at sketched quantiles and rows become one byte a column, once. A pass routes each row through
the trees so far and sums gradients, curvatures and rows by (model, node, column, bin) within its partition; the sums
meet by (model, node, columns), where the best cut is found. The driver sees one row for each of those and holds the
trees. Sums are of integers (gradients as multiples of a power of two), so no order of rows or tasks changes a tree.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from driftcurve.session import with_code
from driftcurve.sources.state import Store

#: Columns whose sums travel together, and rounds after which margins are written instead of computed anew.
CHUNK, REFRESH = 32, 8
#: Bytes of coded rows below which no further task is worth its start.
TASK_BYTES = 1 << 21
#: Bits of a double that sums may use.
SUM_BITS = 52


@dataclass(frozen=True)
class Booster:
    """What may be set of boosted trees: rounds, depth, learning rate, rows of a leaf, penalty on squared leaf values, share of the rows a
    tree sees, bins of a column, the share of the rows that validates, and the rounds without a better validation loss after which
    boosting stops."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.1
    leaf_rows: int = 1
    l2: float = 3.0
    subsample: float = 1.0
    bins: int = 128
    eval_fraction: float = 0.2
    patience: int = 250

    def __post_init__(self):
        if not 2 <= self.bins <= 254:
            raise ValueError("bins must be 2 to 254")


# --- trees ----------------------------------------------------------------------------------------


@dataclass
class Tree:
    """A complete binary tree: column (-1: all go left) and highest code that goes left of each inner node, values of the lowest level."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (1 << depth) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n + 1), np.zeros(n))

    @property
    def depth(self) -> int:
        return len(self.value).bit_length() - 1

    def place(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """The node, numbered within its level, that each row reaches after so many levels."""
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(levels):
            f = self.feature[at]
            at = 2 * at + 1 + ((f >= 0) & (codes[rows, f] > self.cut[at]))
        return at - ((1 << levels) - 1)

    def values(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.place(codes, self.depth)]

    def put_leaf(self, level: int, node: int, value: float) -> None:
        """What rows get that end in a node of a level: they go on to the left."""
        self.value[node << (self.depth - level)] = value


@dataclass
class Boosted:
    """A model: where columns are cut, the margin that all rows start from, the trees, and the validation loss after each round."""

    columns: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return coded(x, self.edges)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        codes, margin = self.codes(x), np.full(len(x), self.start)
        for t in self.trees:
            margin += t.values(codes)
        return 1 / (1 + np.exp(-margin))

    def gains(self) -> np.ndarray:
        """The share of each column in all gains."""
        out = np.zeros(len(self.columns))
        for t in self.trees:
            np.add.at(out, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return out / out.sum() if out.sum() else out

    def to_json(self) -> str:
        trees = [[t.feature.tolist(), t.cut.tolist(), t.value.tolist(), t.gain.tolist()] for t in self.trees]
        return json.dumps({"columns": self.columns, "edges": [e.tolist() for e in self.edges], "start": self.start, "trees": trees, "losses": self.losses})

    @staticmethod
    def from_json(text: str) -> Boosted:
        d = json.loads(text)
        trees = [Tree(np.array(f), np.array(c), np.array(v), np.array(g)) for f, c, v, g in d["trees"]]
        return Boosted(d["columns"], [np.array(e, float) for e in d["edges"]], d["start"], trees, d["losses"])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Boosted:
    return Boosted.from_json(spark.read.text(path, wholetext=True).first()["value"])


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """One byte a column: 0 where it is undefined, else 1 and the number of edges below the value."""
    out = np.zeros(x.shape, np.uint8)
    for k, e in enumerate(edges):
        known = ~np.isnan(x[:, k])
        out[known, k] = 1 + np.searchsorted(e, x[known, k], side="left")
    return out


def best_round(losses: list[float], patience: int) -> int:
    """The round, from 1, with the least loss among those before `patience` rounds brought no better one."""
    best = 0
    for i, x in enumerate(losses):
        if x < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


# --- in tasks -------------------------------------------------------------------------------------


def matrix(batch: pa.RecordBatch, first: int, n: int) -> np.ndarray:
    return np.stack([batch.column(first + i).to_numpy(zero_copy_only=False).astype(float) for i in range(n)], axis=1) if n else np.zeros((batch.num_rows, 0))


def listed(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def bytes_of(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def drawn(keys: np.ndarray, salt: int, share: float) -> np.ndarray:
    """Which rows a tree sees, by their keys' hash."""
    x = keys.astype(np.uint64) + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


@dataclass
class Growing:
    """One model as it grows: its trees since margins were written, the present tree and its open nodes, and how sums are scaled."""

    at: int
    seed: int
    scale: float
    recent: list[Tree]
    tree: Tree
    level: int
    open: list[int]

    def margins(self, codes: np.ndarray, written: np.ndarray) -> np.ndarray:
        out = written.copy()
        for t in self.recent:
            out += t.values(codes)
        return out


def sums(models: list[Growing], n_columns: int, n_models: int, booster: Booster, number: int, losses: bool):
    """A function from coded rows to (block, data): sums of gradient, curvature and rows for each model's open nodes, and validation losses."""
    bins = booster.bins + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {m.at: np.zeros((n_columns, len(m.open), bins, 3)) for m in models}
        lost = {m.at: 0.0 for m in models}
        for b in batches:
            codes = bytes_of(b.column(0), n_columns)
            y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            weights, checks, times, written = (listed(b.column(i), n_models) for i in (2, 3, 4, 5))
            keys = b.column(6).to_numpy(zero_copy_only=False)
            for m in models:
                margin = m.margins(codes, written[:, m.at])
                if losses:
                    own = checks[:, m.at] > 0
                    each = checks[own, m.at] * (np.logaddexp(0, margin[own]) - y[own] * margin[own])
                    lost[m.at] += np.rint(each * (m.scale / 64)).sum()
                node = m.tree.place(codes, m.level)
                index = np.full(1 << m.level, -1)
                index[m.open] = np.arange(len(m.open))
                own = (weights[:, m.at] > 0) & (index[node] >= 0)
                if booster.subsample < 1:
                    own &= drawn(keys, m.seed + number, booster.subsample)
                if not own.any():
                    continue
                p = 1 / (1 + np.exp(-margin[own]))
                w = weights[own, m.at]
                parts = np.rint(w * (p - y[own]) * m.scale), np.rint(w * p * (1 - p) * m.scale), times[own, m.at].astype(float)
                base = index[node[own]] * bins
                for c in range(n_columns):
                    spot = base + codes[own, c]
                    for k, v in enumerate(parts):
                        held[m.at][c, :, :, k] += np.bincount(spot, v, len(m.open) * bins).reshape(-1, bins)
        for m in models:
            for i, node in enumerate(m.open):
                for c in range(0, n_columns, CHUNK):
                    yield pa.RecordBatch.from_pydict({"model": [m.at], "node": [node], "chunk": [c], "data": [held[m.at][c : c + CHUNK, i].tobytes()]}, schema=BLOCK)
            if losses:
                yield pa.RecordBatch.from_pydict({"model": [m.at], "node": [-1], "chunk": [0], "data": [np.array([lost[m.at]]).tobytes()]}, schema=BLOCK)

    return run


BLOCK = pa.schema([("model", pa.int32()), ("node", pa.int32()), ("chunk", pa.int32()), ("data", pa.binary())])
CUT = "model int, node int, gain double, feature int, cut int, g double, h double, n double, gl double, hl double, nl double"


def best_cut(s: np.ndarray, chunk: int, scale: float, booster: Booster) -> tuple:
    """Of summed (columns, bins, 3) the cut with the highest gain, of equal ones the first: (gain, column, code, sums of the node, sums on its left)."""
    s = s / np.array([scale, scale, 1.0])
    left = s.cumsum(axis=1)
    whole = left[:, -1:]
    right = whole - left
    value = lambda x: x[..., 0] ** 2 / (x[..., 1] + booster.l2 + 1e-16)
    gain = value(left) + value(right) - value(whole)
    gain = np.where((left[..., 2] >= max(1, booster.leaf_rows)) & (right[..., 2] >= max(1, booster.leaf_rows)), gain, -np.inf)
    c, t = np.unravel_index(gain.argmax(), gain.shape)
    return (float(gain[c, t]), int(chunk + c), int(t), *whole[c, 0].tolist(), *left[c, t].tolist())


def cuts(scales: list[float], booster: Booster):
    """A function from blocks in order to one row per block: its sums over all partitions, and the best cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def out() -> Iterator[pa.RecordBatch]:
            model, node, chunk = key
            found = (0.0, -1, 0, float(total[0]), *[0.0] * 5) if node < 0 else best_cut(total.reshape(-1, booster.bins + 1, 3), chunk, scales[model], booster)
            names = [f.split()[0] for f in CUT.split(", ")]
            types = [pa.int32() if f.endswith("int") else pa.float64() for f in CUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((model, node, *found), types, strict=True)], names=names)

        for b in batches:
            for i in range(b.num_rows):
                own = tuple(b.column(k)[i].as_py() for k in range(3))
                data = np.frombuffer(b.column(3)[i].as_buffer(), float)
                if own != key:
                    if key is not None:
                        yield from out()
                    key, total = own, data.copy()
                else:
                    total += data
        if key is not None:
            yield from out()

    return run


# --- on tables ------------------------------------------------------------------------------------


def sketched_edges(df: DataFrame, columns: list[str], bins: int, accuracy: int = 10_000) -> list[np.ndarray]:
    """At most bins - 1 cuts of each column, at quantiles from a sketch: one aggregate, whose result is (columns x bins) numbers."""
    number = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    cuts_at = F.array(*(F.lit(i / bins) for i in range(1, bins)))
    found = df.agg(*(F.percentile_approx(number(c), cuts_at, accuracy).alias(f"e{i}") for i, c in enumerate(columns))).first()
    return [np.unique(np.array(found[f"e{i}"] or [], float)) for i in range(len(columns))]


def coded_rows(df: DataFrame, columns: list[str], edges: list[np.ndarray], label: Column, weights: Column, checks: Column, times: Column, start: list[float], key: str) -> DataFrame:
    """(codes, y, weights, checks, times, margins, key): what passes read."""
    kept = {"y": label.cast("double"), "weights": weights.cast("array<double>"), "checks": checks.cast("array<double>"), "times": times.cast("array<double>"), "margins": F.array(*map(F.lit, start)).cast("array<double>"), "key": F.xxhash64(key)}
    names = ["codes", *kept]
    own = df.select(*(v.alias(k) for k, v in kept.items()), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = coded(matrix(b, 6, len(edges)), edges)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in codes], pa.binary()), *(b.column(i) for i in range(6))], names=names)

    return with_code(own).mapInArrow(run, "codes binary, y double, weights array<double>, checks array<double>, times array<double>, margins array<double>, key bigint")


def with_margins(rows: DataFrame, recent: list[list[Tree]], n_columns: int) -> DataFrame:
    """The coded rows with the recent trees of each model added to their margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, margins = bytes_of(b.column(0), n_columns), listed(b.column(5), len(recent)).copy()
            for k, trees in enumerate(recent):
                for t in trees:
                    margins[:, k] += t.values(codes)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(margins) + 1) * len(recent), pa.int32()), pa.array(margins.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], flat, b.column(6)], names=b.schema.names)

    return with_code(rows).mapInArrow(run, rows.schema)


def fit(df: DataFrame, columns: list[str], label: Column, draws: list[tuple[Column, Column, Column]], booster: Booster, seeds: list[int], key: str) -> list[Boosted]:
    """One model for each of `draws` (weight, times the row is drawn, whether it validates), all grown in the same passes over rows coded once.

    A level of all models' trees is one pass. A model stops where `patience` rounds brought no better validation loss and
    keeps the trees up to its best round. It validates only if rows of both labels are left to train on.
    """
    spark = df.sparkSession
    store, n = Store(spark, "boosting"), len(draws)
    y = label.cast("double")
    base = df.select(*(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)), y.alias("y"), F.col(key).alias("k"), F.array(*(w.cast("double") for w, *_ in draws)).alias("w"), F.array(*(t.cast("double") for _, t, _ in draws)).alias("t"), F.array(*(e.cast("boolean") for *_, e in draws)).alias("e"))
    base = store.table(base, "base")
    names = [f"x{i}" for i in range(len(columns))]
    weight = lambda i: F.get("w", F.lit(i)) * F.get("t", F.lit(i))
    apart = lambda i: F.get("e", F.lit(i))
    shape = [f(i).alias(f"{k}{i}") for i in range(n) for k, f in (
        ("p", lambda i: F.sum(F.when(~apart(i), weight(i) * F.col("y")))), ("a", lambda i: F.sum(F.when(~apart(i), weight(i)))), ("v", lambda i: F.sum(F.when(apart(i), weight(i)))),
        ("q", lambda i: F.sum(weight(i) * F.col("y"))), ("s", lambda i: F.sum(weight(i))),
    )]
    found = base.agg(F.count("*").alias("rows"), *shape).first()
    edges = sketched_edges(base, names, booster.bins)
    of = lambda k, i: found[f"{k}{i}"] or 0.0
    mixed = lambda p, a: 0 < p < a
    validates = [of("v", i) > 0 and mixed(of("p", i), of("a", i)) == mixed(of("q", i), of("s", i)) and of("a", i) > 0 for i in range(n)]
    start = [0.0] * n  # even odds
    scale = [2.0 ** (SUM_BITS - int(np.ceil(np.log2(max(of("s", i), 1.0)))) - 1) for i in range(n)]
    trains = F.array(*(F.when(apart(i) & F.lit(validates[i]), 0.0).otherwise(weight(i)) for i in range(n)))
    checks = F.array(*(F.when(apart(i) & F.lit(validates[i]), weight(i)).otherwise(0.0) for i in range(n)))
    tasks = max(1, -(-found["rows"] * (len(columns) + 32 * n) // TASK_BYTES))
    rows = store.table(coded_rows(base.coalesce(tasks), names, edges, F.col("y"), trains, checks, F.col("t"), start, "k"), "rows-0")
    reducers = int(spark.conf.get("spark.sql.shuffle.partitions"))
    models = [Boosted(columns, edges, s) for s in start]
    recent: list[list[Tree]] = [[] for _ in range(n)]
    live = list(range(n))

    def one_pass(growing: list[Growing], number: int, losses: bool) -> list:
        blocks = with_code(rows).mapInArrow(sums(growing, len(columns), n, booster, number, losses), "model int, node int, chunk int, data binary")
        n_blocks = sum(max(1, len(g.open)) for g in growing) * -(-len(columns) // CHUNK)
        if rows.rdd.getNumPartitions() > 1:  # one task's sums are whole and in order
            blocks = blocks.repartition(min(reducers, -(-n_blocks // 8)), "model", "node", "chunk").sortWithinPartitions("model", "node", "chunk")
        got = blocks.mapInArrow(cuts(scale, booster), CUT).collect()
        for r in got:
            if r["node"] < 0:
                models[r["model"]].losses.append(r["g"] * 64 / scale[r["model"]] / max(of("v", r["model"]), 1e-300))
        return [r for r in got if r["node"] >= 0]

    def stopped(i: int) -> bool:
        own = models[i].losses[1:]
        return validates[i] and len(own) > 0 and len(own) - best_round(own, booster.patience) >= booster.patience

    for number in range(booster.rounds):
        growing = {i: Growing(i, seeds[i], scale[i], recent[i], Tree.empty(booster.depth), 0, [0]) for i in live}
        for level in range(booster.depth):
            open_ones = [g for g in growing.values() if g.open]
            if not open_ones:
                break
            grown = one_pass(open_ones, number, level == 0)
            for g in open_ones:
                grow(g, [r for r in grown if r["model"] == g.at], booster)
        for i, g in growing.items():
            models[i].trees.append(g.tree)
            recent[i].append(g.tree)
        live = [i for i in live if not stopped(i)]
        if not live:
            break
        if (number + 1) % REFRESH == 0 and number + 1 < booster.rounds:
            rows = store.table(with_margins(rows, recent, len(columns)), f"rows-{number + 1}")
            store.drop(f"rows-{number + 1 - REFRESH}")
            recent = [[] for _ in range(n)]
    last = [Growing(i, seeds[i], scale[i], recent[i], Tree.empty(booster.depth), 0, []) for i in live if validates[i]]
    if last:
        one_pass(last, booster.rounds, True)
    for i, m in enumerate(models):
        m.losses = m.losses[1:]  # the first is of no tree at all
        if validates[i] and m.losses:
            m.trees = m.trees[: best_round(m.losses, booster.patience)]
    store.drop_all()
    return models


def grow(g: Growing, found: list, booster: Booster) -> None:
    """Cut the open nodes where that gains something; the others, and the lowest ones, become leaves."""
    leaf = lambda a, b: float(-a / (b + booster.l2 + 1e-16) * booster.rate)
    following = []
    for node in g.open:
        r = max((r for r in found if r["node"] == node), key=lambda r: (r["gain"], -r["feature"]))
        if not r["gain"] > 1e-12:
            g.tree.put_leaf(g.level, node, leaf(r["g"], r["h"]) if r["n"] else 0.0)
            continue
        at = (1 << g.level) - 1 + node
        g.tree.feature[at], g.tree.cut[at], g.tree.gain[at] = r["feature"], r["cut"], r["gain"]
        for side, (a, b) in enumerate(((r["gl"], r["hl"]), (r["g"] - r["gl"], r["h"] - r["hl"]))):
            g.tree.put_leaf(g.level + 1, 2 * node + side, leaf(a, b))
            following.append(2 * node + side)
    g.level += 1
    g.open = following if g.level < booster.depth else []


def predict(models: list[Boosted], df: DataFrame, names: list[str]) -> DataFrame:
    """The frame with one column of probabilities for each model; a batch is read and coded once for all that share their cuts."""
    numbers = [F.col(c).cast("double").alias(f"__c{i}_{k}") for i, m in enumerate(models) for k, c in enumerate(m.columns)]
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, got = width, []
            for m in models:
                got.append(pa.array(m.probabilities(matrix(b, first, len(m.columns)))))
                first += len(m.columns)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *got], names=[*b.schema.names[:width], *names])

    schema = StructType([*df.schema.fields, *(StructField(n, DoubleType()) for n in names)])
    return with_code(df.select("*", *numbers)).mapInArrow(run, schema)
