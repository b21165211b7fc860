"""Sequence classifiers: recurrent, attention and perceptron parts, trained and applied partition by partition.

Gradients come from a small reverse-mode tape over numpy. Inputs are tables with `sequence` (an array
of points, each an array of numbers), feature columns, a label and perhaps a weight. Training is data-parallel: a
large mini-batch is read by several tasks, each sums the gradient of its rows, and the driver adds up at most SPREAD
such sums and moves the weights. Small mini-batches depend on each other and are not worth a job each: a task takes a run
of them in turn and hands the weights on. The driver never holds a row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftcurve.operators.ordering import hashed
from driftcurve.session import with_code
from driftcurve.sources import tables
from driftcurve.sources.state import Store

MODES = ("sequence_only", "features_only", "hybrid")
CELLS = ("rnn", "gru", "lstm", "transformer")
POOLING = ("attention", "last")


# --- reverse-mode tape ----------------------------------------------------------------------------


class Node:
    """An array, what it was computed from, and how a gradient goes back."""

    __slots__ = ("data", "grad", "sources")

    def __init__(self, data: np.ndarray, sources: tuple = ()):
        self.data, self.grad, self.sources = data, None, sources

    def __add__(self, o):
        o = node(o)
        return Node(self.data + o.data, ((self, lambda g: g), (o, lambda g: g)))

    def __mul__(self, o):
        o = node(o)
        return Node(self.data * o.data, ((self, lambda g: g * o.data), (o, lambda g: g * self.data)))

    def __sub__(self, o):
        return self + node(o) * -1.0

    def __matmul__(self, o):
        t = lambda a: np.swapaxes(a, -1, -2)
        return Node(self.data @ o.data, ((self, lambda g: g @ t(o.data)), (o, lambda g: t(self.data) @ g)))

    def __getitem__(self, key):
        def back(g):
            out = np.zeros_like(self.data)
            np.add.at(out, key, g)
            return out

        return Node(self.data[key], ((self, back),))

    def reshape(self, *shape):
        return Node(self.data.reshape(shape), ((self, lambda g: g.reshape(self.data.shape)),))

    def transpose(self, *axes):
        back = np.argsort(axes)
        return Node(self.data.transpose(axes), ((self, lambda g: g.transpose(back)),))

    def sum(self, axis):
        return Node(self.data.sum(axis=axis, keepdims=True), ((self, lambda g: np.broadcast_to(g, self.data.shape)),))

    def backward(self) -> None:
        order, seen, todo = [], set(), [(self, False)]
        while todo:
            n, done = todo.pop()
            if done:
                order.append(n)
            elif id(n) not in seen:
                seen.add(id(n))
                todo.append((n, True))
                todo += [(s, False) for s, _ in n.sources]
        self.grad = np.ones_like(self.data)
        for n in reversed(order):
            for s, back in n.sources:
                g = unbroadcast(back(n.grad), s.data.shape)
                s.grad = g if s.grad is None else s.grad + g


def node(x) -> Node:
    return x if isinstance(x, Node) else Node(np.asarray(x, float))


def unbroadcast(g: np.ndarray, shape: tuple) -> np.ndarray:
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(axis=i, keepdims=True)
    return g


def unary(x: Node, y: np.ndarray, slope: np.ndarray) -> Node:
    return Node(y, ((x, lambda g: g * slope),))


def squashed(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)), in place."""
    np.negative(x, out=x)
    np.minimum(x, 40.0, out=x)
    np.exp(x, out=x)
    x += 1
    return np.divide(1.0, x, out=x)


def bent(x: np.ndarray) -> np.ndarray:
    """tanh by one exponential: faster than numpy's."""
    y = squashed(x * 2)
    y *= 2
    y -= 1
    return y


def tanh(x: Node) -> Node:
    y = bent(x.data)
    return unary(x, y, 1 - y * y)


def sigmoid(x: Node) -> Node:
    y = 1 / (1 + np.exp(-np.clip(x.data, -40, 40)))
    return unary(x, y, y * (1 - y))


def relu(x: Node) -> Node:
    return unary(x, np.maximum(x.data, 0), (x.data > 0).astype(float))


def power(x: Node, p: float) -> Node:
    return unary(x, x.data**p, p * x.data ** (p - 1))


def softmax(x: Node, axis: int) -> Node:
    e = np.exp(x.data - x.data.max(axis=axis, keepdims=True))
    y = e / e.sum(axis=axis, keepdims=True)
    return Node(y, ((x, lambda g: y * (g - (g * y).sum(axis=axis, keepdims=True))),))


def concat(parts: list[Node], axis: int) -> Node:
    ends = np.cumsum([0, *(p.data.shape[axis] for p in parts)])
    cut = lambda i: lambda g: np.take(g, range(ends[i], ends[i + 1]), axis=axis)
    return Node(np.concatenate([p.data for p in parts], axis=axis), tuple((p, cut(i)) for i, p in enumerate(parts)))


# --- recurrent layers -----------------------------------------------------------------------------


class Rnn:
    """A step of a cell on (gates * hidden, rows): forward gives the new state and what the way back needs, back fills both inputs' gradients and gives the old state's direct one."""

    gates = 1

    def __init__(self, n: int, h: int):
        self.h = h

    def forward(self, a, b, state):
        new = bent(a + b)
        return new, (new,)

    def back(self, d, state, kept, da, db):
        (new,) = kept
        da[:] = db[:] = d * (1 - new * new)
        return 0.0


class Gru(Rnn):
    gates = 3

    def forward(self, a, b, state):
        h = self.h
        zr, u = squashed(a[: 2 * h] + b[: 2 * h]), b[2 * h :]
        c = bent(a[2 * h :] + zr[h:] * u)
        return c + zr[:h] * (state - c), (zr, u, c)

    def back(self, d, state, kept, da, db):
        h, (zr, u, c) = self.h, kept
        z, r = zr[:h], zr[h:]
        dz = d * z
        dc = (d - dz) * (1 - c * c)
        da[:h], da[h : 2 * h], da[2 * h :] = (d - dz) * z * (state - c), dc * u * r * (1 - r), dc
        db[: 2 * h], db[2 * h :] = da[: 2 * h], dc * r
        return dz


class Lstm(Rnn):
    gates = 4

    def __init__(self, n: int, h: int):
        super().__init__(n, h)
        self.memory, self.slope = np.zeros((h, n)), np.zeros((h, n))

    def forward(self, a, b, state):
        h, g, n = self.h, a + b, a.shape[1]
        gate, t, old = squashed(g[: 3 * h]), bent(g[3 * h :]), self.memory[:, :n].copy()
        new = gate[h : 2 * h] * old + gate[:h] * t
        self.memory[:, :n] = new
        out = bent(new)
        return gate[2 * h :] * out, (gate, t, old, out)

    def back(self, d, state, kept, da, db):
        h, (gate, t, old, out), n = self.h, kept, d.shape[1]
        dm = d * gate[2 * h :] * (1 - out * out) + self.slope[:, :n]
        da[:h], da[h : 2 * h], da[2 * h : 3 * h], da[3 * h :] = dm * t, dm * old, d * out, dm * gate[:h] * (1 - t * t)
        da[: 3 * h] *= gate * (1 - gate)
        db[:] = da
        self.slope[:, :n] = dm * gate[h : 2 * h]
        return 0.0


RECURRENT = {"rnn": Rnn, "gru": Gru, "lstm": Lstm}


def recurrent(cell: str, v: Node, wx: Node, wh: Node, bias: Node, mask: np.ndarray) -> Node:
    """States (rows, steps, hidden) of a layer as one node; rows keep their state once they have ended.

    Rows lie by falling length, so that a step takes those that go on, and what no step waits for is one product.
    """
    (n, steps, c), h = v.data.shape, wh.data.shape[0]
    made = RECURRENT[cell](n, h)
    order = np.argsort(-mask.sum(axis=1), kind="stable")
    back_order, live = np.argsort(order), mask.sum(axis=0).astype(int)
    x = np.ones((steps, c + 1, n))  # the last channel is the bias's
    x[:, :c] = v.data[order].transpose(1, 2, 0)
    a = np.concatenate([wx.data, bias.data[None]]).T @ x
    states, kept, down = np.empty((steps + 1, h, n)), [], np.ascontiguousarray(wh.data.T)
    states[0] = 0
    for t, m in enumerate(live):
        old = states[t, :, :m]
        states[t + 1, :, :m], own = made.forward(a[t, :, :m], down @ old, old)
        states[t + 1, :, m:] = states[t, :, m:]
        kept.append(own)
    found: list[np.ndarray] = []

    def back(g):
        g, d = np.ascontiguousarray(g[order].transpose(1, 2, 0)), np.zeros((h, n))
        da, db = np.empty((2, wx.data.shape[1], n))
        dx, dwx, dwh = np.zeros((steps, c, n)), np.zeros((c + 1, len(da))), np.zeros(wh.data.shape)
        for t in reversed(range(steps)):
            m = live[t]
            d += g[t]
            p, q, old = da[:, :m], db[:, :m], states[t, :, :m]
            direct = made.back(d[:, :m], old, kept[t], p, q)
            d[:, :m] = wh.data @ q + direct
            dwx += x[t, :, :m] @ p.T
            dwh += old @ q.T
            if v.sources:
                dx[t, :, :m] = wx.data @ p
        found.extend((dx.transpose(2, 0, 1)[back_order], dwx[:-1], dwh, dwx[-1]))

    def part(i):
        def of(g):
            if not found:
                back(g)
            return found[i]

        return of

    return Node(states[1:].transpose(2, 0, 1)[back_order], tuple((s, part(i)) for i, s in enumerate((v, wx, wh, bias))))


# --- the model ------------------------------------------------------------------------------------


@dataclass
class Settings:
    mode: str = "hybrid"
    cell: str = "gru"
    pooling: str = "attention"
    hidden: int = 24
    layers: int = 1
    heads: int = 2
    head: tuple[int, ...] = (32,)
    epochs: int = 15
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 42
    balance: bool = True
    columns: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in MODES or self.cell not in CELLS or self.pooling not in POOLING:
            raise ValueError(f"mode is one of {MODES}, cell of {CELLS}, pooling of {POOLING}")
        if self.mode != "sequence_only" and not self.columns:
            raise ValueError(f"mode {self.mode} needs feature columns")
        if self.hidden % self.heads:
            raise ValueError("hidden must be a multiple of heads")


def positions(n: int, width: int) -> np.ndarray:
    """Sines and cosines of a position at geometrically spaced rates."""
    rate = np.exp(-np.log(10_000.0) * np.arange(0, width, 2) / width)
    angle = np.arange(n)[:, None] * rate
    out = np.zeros((n, width))
    out[:, 0::2] = np.sin(angle)
    out[:, 1::2] = np.cos(angle[:, : width // 2])
    return out


@dataclass
class Moments:
    """Number, means and summed squared deviations of rows of numbers, which add up exactly however the rows are dealt out."""

    n: int
    mean: np.ndarray
    squares: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Moments:
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        return Moments(len(x), mean, ((x - mean) ** 2).sum(axis=0))

    def __add__(self, o: Moments) -> Moments:
        n = self.n + o.n
        if not self.n or not o.n:
            return self if self.n else o
        move = o.mean - self.mean
        return Moments(n, self.mean + move * (o.n / n), self.squares + o.squares + move**2 * (self.n * o.n / n))

    def spread(self) -> np.ndarray:
        std = np.sqrt(self.squares / max(1, self.n))
        return np.where(std > 1e-8, std, 1.0)


def scale_of(points: Moments, features: Moments) -> dict[str, np.ndarray]:
    return {"m": points.mean, "s": points.spread(), "fm": features.mean, "fs": features.spread()}


def balanced(n: int, positive: int) -> tuple[float, float]:
    """What a positive and a negative row weigh, so that both labels weigh the same in all."""
    return (n / (2 * positive), n / (2 * (n - positive))) if 0 < positive < n else (1.0, 1.0)


class Adam:
    """Running means of gradients and of their squares."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.first, self.second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
        self.step = 0

    def move(self, weights: dict[str, np.ndarray], grad: dict[str, np.ndarray], rate: float, decay: float) -> None:
        self.step += 1
        for k, v in weights.items():
            d = grad[k] + decay * v
            self.first[k] = 0.9 * self.first[k] + 0.1 * d
            self.second[k] = 0.999 * self.second[k] + 0.001 * d * d
            weights[k] = v - rate * self.first[k] / (1 - 0.9**self.step) / (np.sqrt(self.second[k] / (1 - 0.999**self.step)) + 1e-8)


@dataclass
class SequenceModel:
    settings: Settings
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    scale: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, channels: int, features: int) -> None:
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        put = lambda name, *shape: self.weights.__setitem__(name, rng.normal(size=shape) / np.sqrt(shape[0]))
        zero = lambda name, n: self.weights.__setitem__(name, np.zeros(n))
        h, width = s.hidden, 0
        if s.mode != "features_only":
            width = h
            if s.cell == "transformer":
                put("in", channels, h)
                put("cls", 1, h)
                for k in range(s.layers):
                    for name in ("q", "k", "v", "o"):
                        put(f"{name}{k}", h, h)
                    put(f"up{k}", h, 2 * h), put(f"down{k}", 2 * h, h)
                    zero(f"upb{k}", 2 * h), zero(f"downb{k}", h)
                    for name in ("n1", "n2"):
                        self.weights[f"{name}g{k}"] = np.ones(h)
                        zero(f"{name}b{k}", h)
            else:
                gates = RECURRENT[s.cell].gates
                for k in range(s.layers):
                    put(f"x{k}", channels if k == 0 else h, gates * h), put(f"h{k}", h, gates * h), zero(f"b{k}", gates * h)
                put("att", h, h), put("attv", h, 1)
        width += features if s.mode != "sequence_only" else 0
        for k, n in enumerate((*s.head, 1)):
            put(f"head{k}", width, n), zero(f"headb{k}", n)
            width = n

    def encode(self, w: dict[str, Node], x: np.ndarray, mask: np.ndarray) -> Node:
        """(batch, hidden) of padded sequences; masked points change nothing."""
        s, h = self.settings, self.settings.hidden
        if s.cell == "transformer":
            return self.attend(w, x, mask)
        v = node(x)
        for k in range(s.layers):
            v = recurrent(s.cell, v, w[f"x{k}"], w[f"h{k}"], w[f"b{k}"], mask)
        if s.pooling == "last":
            return v[:, -1]
        score = (tanh(v.reshape(-1, h) @ w["att"]) @ w["attv"]).reshape(*mask.shape, 1)
        share = softmax(score + np.where(mask[:, :, None] > 0, 0.0, -1e9), 1)
        return (v * share).sum(1).reshape(len(x), h)

    def attend(self, w: dict[str, Node], x: np.ndarray, mask: np.ndarray) -> Node:
        s, h = self.settings, self.settings.hidden
        n, t, c = x.shape
        points = (node(x.reshape(-1, c)) @ w["in"]).reshape(n, t, h)
        first = node(np.zeros((n, 1, h))) + w["cls"].reshape(1, 1, h)
        v = concat([first, points], 1) + positions(t + 1, h)
        t += 1
        off = np.where(np.concatenate([np.ones((n, 1)), mask], axis=1) > 0, 0.0, -1e9)[:, None, None, :]
        d = h // s.heads
        split = lambda y: y.reshape(n, t, s.heads, d).transpose(0, 2, 1, 3)
        for k in range(s.layers):
            y = self.normed(v, w[f"n1g{k}"], w[f"n1b{k}"]).reshape(n * t, h)
            q, key, val = (split(y @ w[f"{name}{k}"]) for name in ("q", "k", "v"))
            share = softmax((q @ key.transpose(0, 1, 3, 2)) * (d**-0.5) + off, 3)
            v = v + ((share @ val).transpose(0, 2, 1, 3).reshape(n * t, h) @ w[f"o{k}"]).reshape(n, t, h)
            y = self.normed(v, w[f"n2g{k}"], w[f"n2b{k}"]).reshape(n * t, h)
            v = v + (relu(y @ w[f"up{k}"] + w[f"upb{k}"]) @ w[f"down{k}"] + w[f"downb{k}"]).reshape(n, t, h)
        return v[:, 0]

    def normed(self, v: Node, gain: Node, shift: Node) -> Node:
        n = v.data.shape[-1]
        dev = v - v.sum(2) * (1 / n)
        return dev * power((dev * dev).sum(2) * (1 / n) + 1e-5, -0.5) * gain + shift

    def logits(self, w: dict[str, Node], sequences: list[np.ndarray], features: np.ndarray) -> Node:
        s, parts = self.settings, []
        if s.mode != "features_only":
            x, mask = padded(sequences)
            parts.append(self.encode(w, (x - self.scale["m"]) / self.scale["s"] * mask[:, :, None], mask))
        if s.mode != "sequence_only":
            parts.append(node((features - self.scale["fm"]) / self.scale["fs"]))
        v = parts[0] if len(parts) == 1 else concat(parts, 1)
        for k in range(len(s.head)):
            v = relu(v @ w[f"head{k}"] + w[f"headb{k}"])
        return v @ w[f"head{len(s.head)}"] + w[f"headb{len(s.head)}"]

    def gradient(self, sequences: list[np.ndarray], features: np.ndarray, labels: np.ndarray, sample: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The weighted logistic loss of some rows and its gradient, both as sums."""
        w = {k: Node(v) for k, v in self.weights.items()}
        z = self.logits(w, sequences, features)
        y, g = labels[:, None].astype(float), sample[:, None]
        loss = Node(np.zeros(()), ((z, lambda _: (sigmoid(z).data - y) * g),))
        loss.backward()
        return float((g * (np.logaddexp(0, z.data) - y * z.data)).sum()), {k: n.grad if n.grad is not None else np.zeros_like(n.data) for k, n in w.items()}

    def fit(self, sequences: list[np.ndarray], features: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None, report: Callable[[int, float], None] | None = None, batches: np.ndarray | None = None) -> SequenceModel:
        """Adam on the weighted logistic loss, in one process; with `balance` both labels weigh the same in all.

        Mini-batches are drawn anew each epoch, or are those that `batches` numbers, in an order drawn anew.
        """
        s, rng = self.settings, np.random.default_rng(self.settings.seed)
        if len(sequences) != len(labels) or len(features) != len(labels):
            raise ValueError("sequences, features and labels differ in number")
        every = np.concatenate(sequences) if sequences else np.zeros((0, 1))
        self.scale = scale_of(Moments.of(every), Moments.of(features))
        self.start(every.shape[1], features.shape[1])
        sample = np.ones(len(labels)) if weights is None else np.asarray(weights, float).copy()
        if s.balance:
            sample *= np.where(labels == 1, *balanced(len(labels), int(labels.sum())))
        adam = Adam(self.weights)
        for epoch in range(s.epochs):
            total = 0.0
            if batches is None:
                order = rng.permutation(len(labels))
                parts = [order[lo : lo + s.batch] for lo in range(0, len(order), s.batch)]
            else:
                parts = [np.flatnonzero(batches == k) for k in rng.permutation(int(batches.max()) + 1)]
            for own in parts:
                if len(own):
                    loss, grad = self.gradient([sequences[i] for i in own], features[own], labels[own], sample[own])
                    total += loss / len(own)
                    adam.move(self.weights, {k: g / len(own) for k, g in grad.items()}, s.rate, s.decay)
            if report:
                report(epoch, total)
        return self

    def probabilities(self, sequences: list[np.ndarray], features: np.ndarray) -> np.ndarray:
        if not len(features):
            return np.zeros(0)
        w = {k: Node(v) for k, v in self.weights.items()}
        order = np.argsort([len(x) for x in sequences], kind="stable")
        out = np.zeros(len(features))
        for lo in range(0, len(order), 256):  # of like lengths, so little is padding
            own = order[lo : lo + 256]
            out[own] = sigmoid(self.logits(w, [sequences[i] for i in own], features[own])).data[:, 0]
        return out

    def to_json(self) -> str:
        arrays = lambda d: {k: [list(v.shape), v.ravel().tolist()] for k, v in d.items()}
        return json.dumps({"settings": asdict(self.settings), "weights": arrays(self.weights), "scale": arrays(self.scale)})

    @staticmethod
    def from_json(text: str) -> SequenceModel:
        d = json.loads(text)
        arrays = lambda x: {k: np.array(v).reshape(shape) for k, (shape, v) in x.items()}
        d["settings"]["head"], d["settings"]["columns"] = tuple(d["settings"]["head"]), tuple(d["settings"]["columns"])
        return SequenceModel(Settings(**d["settings"]), arrays(d["weights"]), arrays(d["scale"]))


def padded(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Zeros up to the longest, and a mask of what is true."""
    longest = max(1, max(len(x) for x in sequences))
    x = np.zeros((len(sequences), longest, sequences[0].shape[1]))
    mask = np.zeros((len(sequences), longest))
    for i, v in enumerate(sequences):
        x[i, : len(v)] = v
        mask[i, : len(v)] = 1
    return x, mask


# --- on tables ------------------------------------------------------------------------------------


def arrays_of(column: pa.Array, width: int) -> list[np.ndarray]:
    """Each row's points; a missing or empty sequence is one point of zeros, undefined numbers are 0."""
    if column.null_count == len(column) or not len(column.flatten()):
        return [np.zeros((1, width))] * len(column)
    ends, points = column.offsets.to_numpy(), column.values
    inner = points.offsets.to_numpy()[ends[0] : ends[-1] + 1]
    sizes = np.diff(inner)
    if points.slice(ends[0], ends[-1] - ends[0]).null_count or sizes.min() != sizes.max() or not sizes[0]:
        raise ValueError("points differ in their number of channels")
    flat = points.values.slice(inner[0], inner[-1] - inner[0]).to_numpy(zero_copy_only=False).astype(float)
    rows = np.nan_to_num(flat, posinf=1e6, neginf=-1e6).reshape(len(sizes), -1)
    cut, there = ends - ends[0], column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(ends) > 0)
    return [rows[cut[i] : cut[i + 1]] if there[i] else np.zeros((1, width)) for i in range(len(column))]


#: Tasks that share a mini-batch at most, and folders that mini-batches lie in.
SPREAD, FOLDERS = 8, 512
#: Rows of a mini-batch that one task takes alone, and rows of a run of such mini-batches.
ALONE, RUN = 256, 1 << 15


def batch_of(settings: Settings, key: str, batches: int) -> Column:
    """A row's mini-batch, by its hash."""
    return F.pmod(F.conv(F.substring(hashed(settings.seed, key), 1, 8), 16, 10).cast("bigint"), F.lit(batches))


def read_rows(b: pa.RecordBatch, width: int, n_features: int) -> tuple:
    """Sequences, features, labels and weights of a batch of (sequence, y, w, features...)."""
    features = np.stack([b.column(3 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(n_features)], axis=1) if n_features else np.zeros((b.num_rows, 0))
    return arrays_of(b.column(0), width), np.nan_to_num(features, posinf=1e6, neginf=-1e6), b.column(1).to_numpy(zero_copy_only=False).astype(int), b.column(2).to_numpy(zero_copy_only=False).astype(float)


def moments_of(rows: DataFrame, width: int, n_features: int) -> tuple[Moments, Moments]:
    """Of all points and of all features; a row a task comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, features = Moments.of(np.zeros((0, width))), Moments.of(np.zeros((0, n_features)))
        for b in batches:
            x, f, _, _ = read_rows(b, width, n_features)
            points, features = points + Moments.of(np.concatenate(x)), features + Moments.of(f)
        pack = lambda m: [float(m.n), *m.mean.tolist(), *m.squares.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([pack(points)]), pa.array([pack(features)])], names=["p", "f"])

    unpack = lambda v, n: Moments(int(v[0]), np.array(v[1 : n + 1]), np.array(v[n + 1 :]))
    points, features = Moments.of(np.zeros((0, width))), Moments.of(np.zeros((0, n_features)))
    for r in with_code(rows).mapInArrow(run, "p array<double>, f array<double>").collect():
        points, features = points + unpack(r["p"], width), features + unpack(r["f"], n_features)
    return points, features


def summed_gradient(model: SequenceModel, rows: DataFrame, weigh: tuple[float, float]) -> tuple[int, float, dict[str, np.ndarray]]:
    """Rows, loss and gradient of a mini-batch, summed by its tasks, whose sums the driver adds up."""
    width, n_features = len(model.scale["m"]), len(model.scale["fm"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, grad = 0, 0.0, {k: np.zeros_like(v) for k, v in model.weights.items()}
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                x, f, y, w = read_rows(b, width, n_features)
                more, g = model.gradient(x, f, y, w * np.where(y == 1, *weigh))
                n, loss, grad = n + len(y), loss + more, {k: v + g[k] for k, v in grad.items()}
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([loss]), pa.array([np.concatenate([v.ravel() for v in grad.values()])])], names=["n", "loss", "grad"])

    got = with_code(rows).mapInArrow(run, "n bigint, loss double, grad array<double>").collect()
    flat = np.sum([r["grad"] for r in got], axis=0) if got else np.zeros(0)
    grad, at = {}, 0
    for k, v in model.weights.items() if got else ():
        grad[k], at = flat[at : at + v.size].reshape(v.shape), at + v.size
    return sum(r["n"] for r in got), sum(r["loss"] for r in got), grad


def run_of_steps(model: SequenceModel, adam: Adam, rows: DataFrame, weigh: tuple[float, float]) -> float:
    """Move the model through the mini-batches of (place, sequence, y, w, features...) in the order of `place`; the sum of their mean losses.

    One task holds a part of a mini-batch at a time. What comes to the driver is three times as long as the weights.
    """
    width, n_features = len(model.scale["m"]), len(model.scale["fm"])
    joined = lambda d: np.concatenate([v.ravel() for v in d.values()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, place, n, loss, grad = 0.0, None, 0, 0.0, {}

        def move() -> float:
            adam.move(model.weights, {k: g / n for k, g in grad.items()}, model.settings.rate, model.settings.decay)
            return loss / n

        for whole in batches:
            places = whole.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(places, prepend=-1))
            for lo, hi in zip(starts, [*starts[1:], len(places)], strict=True):
                if n and places[lo] != place:
                    total, n, loss, grad = total + move(), 0, 0.0, {}
                place = places[lo]
                for at in range(lo, hi, 256):
                    x, f, y, w = read_rows(whole.slice(at, min(256, hi - at)).select(whole.schema.names[1:]), width, n_features)
                    more, g = model.gradient(x, f, y, w * np.where(y == 1, *weigh))
                    n, loss, grad = n + len(y), loss + more, {k: v + grad[k] for k, v in g.items()} if grad else g
        if n:
            total += move()
        yield pa.RecordBatch.from_arrays([pa.array([joined(d)]) for d in (model.weights, adam.first, adam.second)] + [pa.array([adam.step]), pa.array([total])], names=["weights", "first", "second", "step", "loss"])

    in_order = with_code(rows).coalesce(1).sortWithinPartitions("place", F.xxhash64("__key")).drop("__key")
    got = in_order.mapInArrow(run, "weights array<double>, first array<double>, second array<double>, step bigint, loss double").first()
    at = 0
    for k, v in model.weights.items():
        to = at + v.size
        for own, name in ((adam.first, "first"), (adam.second, "second"), (model.weights, "weights")):
            own[k] = np.array(got[name][at:to]).reshape(v.shape)
        at = to
    adam.step = got["step"]
    return got["loss"]


def in_runs(store: Store, rows: DataFrame, order: np.ndarray, batch: int) -> Iterator[DataFrame]:
    """Rows (batch, ...) in runs of whole mini-batches in an order: dealt out in one shuffle, then read run by run as (place, ...)."""
    size = max(1, RUN // batch)
    runs = -(-len(order) // size)
    places = store.spark.createDataFrame(pa.table({"batch": pa.array(order, pa.int64()), "place": pa.array(np.arange(len(order)), pa.int64())}))
    dealt = rows.join(F.broadcast(places), "batch").drop("batch").withColumn("run", F.floor(F.col("place") / size).cast("int"))
    dealt = store.table(dealt.repartition(min(runs, 4096), "run"), "epoch", by="run")
    for k in range(runs):
        yield dealt.where(F.col("run") == k).drop("run")
    store.drop("epoch")


def train(df: DataFrame, settings: Settings, label: str = "class", weight: str | None = None, key: str = "row_index", report: Callable[[int, float], None] | None = None) -> SequenceModel:
    """Fit on all rows: as SequenceModel.fit, with mini-batches of some `batch` rows by their hash.

    Mini-batches of up to ALONE rows are taken in runs, each epoch's dealt out anew, a task for each run; a lost executor
    costs a run. For larger ones rows are written once, dealt out and sorted by mini-batch, and each step is a pass of at
    most SPREAD tasks; a lost executor costs a step's tasks. Scales and the labels' shares come from one pass each.
    """
    sequence = F.col("sequence").cast("array<array<double>>") if "sequence" in df.columns else F.lit(None).cast("array<array<double>>")
    features = [F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(settings.columns)]
    own = df.select(sequence.alias("sequence"), F.col(label).cast("int").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), *features, F.col(key).alias("__key"))
    store = Store(df.sparkSession, "networks")
    first = own.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 1).alias("pos"), F.max(F.size(F.get("sequence", F.lit(0)))).alias("width")).first()
    batches = max(1, -(-first["n"] // settings.batch))
    alone = settings.batch <= ALONE
    own = own.withColumn("batch", batch_of(settings, "__key", batches))
    if alone:
        rows = store.table(own, "rows")
    else:
        dealt = own.withColumn("folder", F.pmod(F.col("batch"), F.lit(FOLDERS))).withColumn("part", F.pmod(F.xxhash64("__key"), F.lit(min(SPREAD, -(-settings.batch // 32))))).drop("__key")
        dealt = dealt.repartition(min(batches * SPREAD, 4096), "folder", "part").sortWithinPartitions("folder", "batch")
        rows = store.table(dealt, "rows", by="folder").drop("part")
    names = ["sequence", "y", "w", *(f"f{i}" for i in range(len(features)))]
    model = SequenceModel(settings)
    width = max(1, first["width"] or 1)
    model.scale = scale_of(*moments_of(rows.select(names), width, len(features)))
    model.start(width, len(features))
    weigh = balanced(first["n"], first["pos"]) if settings.balance else (1.0, 1.0)
    adam, rng = Adam(model.weights), np.random.default_rng(settings.seed)
    for epoch in range(settings.epochs):
        total, order = 0.0, rng.permutation(batches)
        if alone:
            for run in in_runs(store, rows, order, settings.batch):
                total += run_of_steps(model, adam, run.select("place", *names, "__key"), weigh)
        for k in () if alone else order:
            step = rows.where((F.col("folder") == int(k) % FOLDERS) & (F.col("batch") == int(k))).select(names)
            n, loss, grad = summed_gradient(model, step, weigh)
            if n:
                total += loss / n
                adam.move(model.weights, {name: g / n for name, g in grad.items()}, settings.rate, settings.decay)
        if report:
            report(epoch, total)
    store.drop_all()
    return model


def predict(model: SequenceModel, df: DataFrame, key: str = "row_index") -> DataFrame:
    """(key, p): the model travels with the tasks; each scores its own rows."""
    columns = model.settings.columns
    sequence = F.col("sequence").cast("array<array<double>>") if "sequence" in df.columns else F.lit(None).cast("array<array<double>>")
    own = df.select(key, sequence.alias("sequence"), *(F.col(c).cast("double") for c in columns))
    width = len(model.scale["m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                features = np.stack([b.column(2 + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(columns))], axis=1) if columns else np.zeros((b.num_rows, 0))
                p = model.probabilities(arrays_of(b.column(1), width), np.nan_to_num(features, posinf=1e6, neginf=-1e6))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=[key, "p"])

    return with_code(own).mapInArrow(run, f"{key} {dict(own.dtypes)[key]}, p double")


def predict_cached(model: SequenceModel, df: DataFrame, folder: str, key: str = "row_index") -> DataFrame:
    """As predict, kept under a name that follows from the model and from what it is shown, and read again for the same ones.

    What the rows hold is told by their number and the sum of their hashes, one aggregate over the columns that the
    model sees; a table without the marker that the committer writes last is made again.
    """
    seen = [key, *(["sequence"] if "sequence" in df.columns else []), *model.settings.columns]
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*seen).cast("decimal(38,0)")).alias("h")).first()
    tag = hashlib.sha256(f"{model.to_json()}|{key}|{r['n']}|{r['h']}".encode()).hexdigest()[:16]
    path = f"{folder}/predictions_{tag}.parquet"
    if not tables.exists(df.sparkSession, f"{path}/_SUCCESS"):
        tables.write(predict(model, df, key), path)
    return df.sparkSession.read.parquet(path)


def save(spark: SparkSession, model: SequenceModel, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> SequenceModel:
    return SequenceModel.from_json(spark.read.text(path, wholetext=True).first()["value"])
