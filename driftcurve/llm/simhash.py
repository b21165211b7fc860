"""SimHash near-dedup: fingerprints, shards, exact pairs inside a shard, verified similarity for wide fingerprints, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftcurve.llm.components import connected_components
from driftcurve.llm.storage import Scratch, free_prefix
from driftcurve.session import with_code

SEED = 42
#: Fingerprints that the driver takes to place vantage points (or to find hot buckets): so many a shard, at least and at most.
PER_SHARD, SAMPLE, MOST_SAMPLE = 16, 16_384, 1 << 20
#: Distinct fingerprints that a shard should hold: at least; as many as make SHARDS shards; at most.
SHARD_ROWS, SHARDS, MOST_ROWS = 2048, 1024, 1 << 16
LEAF = 512
#: A ball splits a set if its larger side holds this share of it at most, and both sides this many times the set.
SPLIT, OVERLAP = 0.85, 1.5
#: Rows and their neighbours that one task looks up at a time.
LOOK_UP = 1 << 20
#: Candidate hubs of a group whose sets are too many for one task, which are more than VERIFY_ROWS.
HUBS, VERIFY_ROWS = 8, 512
#: Bytes that are kept of a shingle's hash where sets are compared: two shingles of a pair of n are taken for one another with a chance of n^2 / 2^40.
SET_BYTES = 5
#: Largest radius that vantage-point shards search; that of wide fingerprints' first words.
BALL, FIRST_WORD = 4, 2
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


# --- fingerprints -----------------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of a text, repeats included, as uint64."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not found:
        return np.empty(0, np.uint64)
    if len(found) <= words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64)


def remixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th word of bits that a shingle's hash stands for; the 0th is the hash itself."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64((MIX[0] * k) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[2])
        return z ^ (z >> np.uint64(31))


def fingerprint(h: np.ndarray, n_words: int = 1, chunk: int = 1 << 15) -> np.ndarray:
    """Bits set in over half of the hashes; zero without hashes. Memory is bounded by `chunk` hashes."""
    out = np.zeros(n_words, np.uint64)
    for k in range(n_words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), chunk):
            part = remixed(h[at : at + chunk], k)
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
    return out


def word_names(n_words: int) -> list[str]:
    return [f"f{k}" for k in range(n_words)]


def fingerprints(docs: DataFrame, words: int, n_words: int = 1) -> DataFrame:
    """(doc_id, f0 ...): each row's whole text as a fingerprint of 64 * n_words bits, in signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            fps = np.array([fingerprint(shingle_hashes(texts[i].as_py(), words), n_words) for i in range(len(texts))], np.uint64).reshape(-1, n_words)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(fps[:, k].view(np.int64)) for k in range(n_words))], names=["doc_id", *word_names(n_words)])

    schema = "doc_id bigint, " + ", ".join(f"{x} bigint" for x in word_names(n_words))
    return with_code(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, schema)


def packed_set(h: np.ndarray) -> bytes:
    """The last SET_BYTES bytes of sorted distinct hashes."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def unpacked_set(shingles: bytes) -> np.ndarray:
    """The distinct numbers of a packed set, sorted."""
    own = np.zeros((len(shingles) // SET_BYTES, 8), np.uint8)
    own[:, :SET_BYTES] = np.frombuffer(shingles, np.uint8).reshape(-1, SET_BYTES)
    return np.unique(own.view("<u8")[:, 0])


def shingled(docs: DataFrame, words: int, n_words: int) -> DataFrame:
    """As fingerprints, with `same`, a hash of the set of shingles, and `shingles`, the set in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, same, sets = np.zeros((b.num_rows, n_words), np.uint64), [], []
            for i in range(b.num_rows):
                h = shingle_hashes(b.column(1)[i].as_py(), words)
                fps[i] = fingerprint(h, n_words)
                distinct = np.unique(h)
                sets.append(packed_set(distinct))
                same.append(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))
            made = [*(pa.array(fps[:, k].copy().view(np.int64)) for k in range(n_words)), pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(sets, pa.large_binary()).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=["doc_id", *word_names(n_words), "same", "shingles"])

    schema = "doc_id bigint, " + ", ".join(f"{x} bigint" for x in word_names(n_words)) + ", same bigint, shingles binary"
    return with_code(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))).mapInArrow(run, schema)


# --- exact pairs within a shard ----------------------------------------------------------------


class Forest:
    """Union-find over 0..n-1 whose roots are the smallest members."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def roots(self, idx: np.ndarray) -> np.ndarray:
        return np.fromiter((self.root(i) for i in idx.tolist()), np.int64, len(idx))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of rows of words: (n, w) against (m, w) gives (n, m)."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
    for k in range(1, a.shape[1]):
        out += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


def link_block(fps: np.ndarray, idx: np.ndarray, radius: int, forest: Forest, block: int = LEAF) -> None:
    """Join all pairs within `radius` among the rows `idx`, block against block, so memory stays bounded.

    Pairs that are connected already are dropped before they are walked one by one.
    """
    w = fps.shape[1]
    loose = radius if w == 1 else first_word_radius(radius, w)
    for i in range(0, len(idx), block):
        a = idx[i : i + block]
        for j in range(i, len(idx), block):
            b = idx[j : j + block]
            x, y = np.nonzero(distances(fps[a][:, :1], fps[b][:, :1]) <= loose)
            if i == j:
                x, y = x[x < y], y[x < y]
            if not len(x):
                continue
            if w > 1 and len(x):
                d = sum(np.bitwise_count(fps[a[x], k] ^ fps[b[y], k]).astype(np.int32) for k in range(w))
                x, y = x[d <= radius], y[d <= radius]
            p, q = forest.roots(a)[x], forest.roots(b)[y]
            for key in np.unique(np.minimum(p, q)[p != q] * len(fps) + np.maximum(p, q)[p != q]).tolist():
                forest.join(*divmod(key, len(fps)))


def first_word_radius(radius: int, n_words: int) -> int:
    """Differing bits of 64 beyond which a pair within `radius` of all bits practically never lies (5 sigma)."""
    p = radius / (64 * n_words)
    return min(64, math.ceil(64 * p + 5 * math.sqrt(64 * p * (1 - p))))


def best_radius(d: np.ndarray, radius: int) -> tuple[int, float]:
    """The split that leaves the larger side smallest, and that side's share. Inside: d <= mu; outside: d > mu - radius."""
    at = np.bincount(d, minlength=66).cumsum()
    n = len(d)
    sides = [(max(at[mu], n - (at[mu - radius] if mu >= radius else 0)) / n, mu) for mu in range(int(d.min()), int(d.max()))]
    share, mu = min(sides, default=(1.0, 0))
    return mu, share


def vantage(fps: np.ndarray, rng: np.random.Generator, radius: int, tries: int = 6) -> tuple[int, int, float]:
    """The row, of a few, that splits these fingerprints best; its radius; the larger side's share."""
    some = fps if len(fps) <= 4096 else fps[rng.choice(len(fps), 4096, replace=False)]
    best = (1.1, 0, 0)
    for i in rng.choice(len(fps), min(tries, len(fps)), replace=False).tolist():
        mu, share = best_radius(np.bitwise_count(some ^ fps[i]), radius)
        best = min(best, (share, i, mu))
    return best[1], best[2], best[0]


def masks(flips: int) -> np.ndarray:
    """All words of 64 bits with at most so many ones, those with fewer first."""
    return np.array([sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(64), k)], np.uint64)


def neighbour_keys(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each fingerprint's neighbours, (n, m), and which of the m columns lie within radius // 2 bits.

    Two fingerprints within `radius` bits have a common neighbour that lies within radius // 2 bits of the
    one and within the rest of the radius of the other; and two that share such a neighbour differ in no
    more than `radius` bits. So fingerprints need only be grouped by neighbour, and a group is a star
    around any one that is near. However crowded the fingerprints are, a group is small.
    """
    far = masks(radius - radius // 2)
    return fps[:, None] ^ far[None, :], np.bitwise_count(far) <= radius // 2


def link_neighbours(key: np.ndarray, near: np.ndarray, row: np.ndarray, forest: Forest) -> None:
    """Join the rows of each key to its first near row."""
    order = np.lexsort((~near, key))
    key, near, row = key[order], near[order], row[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    pair = near[lead] & (row != row[lead])
    n = len(forest.up)
    for p in np.unique(row[pair] * n + row[lead][pair]).tolist():
        forest.join(*divmod(p, n))


def link_crowd(fps: np.ndarray, idx: np.ndarray, radius: int, forest: Forest) -> None:
    """Join all pairs within `radius` among rows that no ball splits, by their neighbours, some keys at a time."""
    wide = len(masks(radius - radius // 2))
    if len(idx) < 4 * wide:
        return link_block(fps[:, None], idx, radius, forest)
    passes = -(-len(idx) * wide // LOOK_UP)
    step = max(1, LOOK_UP // wide)
    for k in range(passes):
        found = []
        for at in range(0, len(idx), step):
            keys, near = neighbour_keys(fps[idx[at : at + step]], radius)
            r, c = np.nonzero(remixed(keys, 1) % np.uint64(passes) == k)
            found.append((keys[r, c], near[c], idx[at + r]))
        link_neighbours(*(np.concatenate(x) for x in zip(*found, strict=True)), forest)


def link_tree(fps: np.ndarray, radius: int, forest: Forest, leaf: int = LEAF) -> None:
    """Join all pairs of one-word fingerprints within `radius`, by a vantage-point tree.

    Rows inside the ball but within `radius` of its edge also go outside. By the triangle bound a
    close pair then meets on some side at every node, so in some leaf; leaves compare all pairs.
    A set that no ball splits is joined by its neighbours.
    """
    rng = np.random.default_rng(SEED)
    todo = [np.arange(len(fps))]
    while todo:
        idx = todo.pop()
        if len(idx) <= leaf:
            link_block(fps[:, None], idx, radius, forest)
            continue
        v, mu, share = vantage(fps[idx], rng, radius)
        d = np.bitwise_count(fps[idx] ^ fps[idx[v]]).astype(np.int16)
        sides = [idx[d <= mu], idx[d > mu - radius]]
        if share > SPLIT or sum(map(len, sides)) > OVERLAP * len(idx):
            link_crowd(fps, idx, radius, forest)
        else:
            todo += sides


# --- shards ------------------------------------------------------------------------------------


@dataclass
class Node:
    centre: int = 0
    mu: int = 0
    inside: Node | None = None
    outside: Node | None = None
    shard: int = -1
    crowded: bool = False


def shard_rows(total: int) -> int:
    """What a shard should hold. SHARDS shards do, until each holds what a task should; from there on shards grow in number."""
    return min(max(total // SHARDS, SHARD_ROWS), MOST_ROWS)


def sample_size(total: int) -> int:
    return min(max(PER_SHARD * (total // shard_rows(total)), SAMPLE), MOST_SAMPLE)


def plan_tree(sample: np.ndarray, total: int, radius: int, copies: int = 16) -> tuple[Node, int]:
    """A vantage-point tree over a sample whose leaves hold about `shard_rows` of `total` rows; its number of leaves.

    A leaf that holds over four times SHARD_ROWS and that no ball splits is crowded: its rows are not dealt by
    place but by their neighbours. So are large leaves once splitting has copied the sample `copies` times.
    """
    rng = np.random.default_rng(SEED)
    scale = len(sample) / max(total, 1)
    per_leaf = max(shard_rows(total) * scale, 8)
    root, n = Node(), 0
    left = copies * len(sample)
    todo = [(-len(sample), 0, root, sample)]
    made = 1
    while todo:
        _, _, node, part = heappop(todo)
        if len(part) > per_leaf and left > 0:
            i, mu, share = vantage(part, rng, radius)
            d = np.bitwise_count(part ^ part[i]).astype(np.int16)
            sides = part[d <= mu], part[d > mu - radius]
            if share <= SPLIT and sum(map(len, sides)) <= OVERLAP * len(part):
                node.centre, node.mu, node.inside, node.outside = int(part[i]), mu, Node(), Node()
                left -= sum(map(len, sides)) - len(part)
                for child, side in zip((node.inside, node.outside), sides, strict=True):
                    heappush(todo, (-len(side), made, child, side))
                    made += 1
                continue
        node.shard, node.crowded = n, len(part) > max(per_leaf, 4 * SHARD_ROWS * scale)
        n += 1
    return root, n


def route(node: Node, fps: np.ndarray, idx: np.ndarray, radius: int) -> Iterator[tuple[Node, np.ndarray]]:
    """The leaves of a batch that a row's ball of `radius` can share with a partner."""
    if node.shard >= 0:
        yield node, idx
    elif len(idx):
        d = np.bitwise_count(fps[idx] ^ np.uint64(node.centre)).astype(np.int16)
        yield from route(node.inside, fps, idx[d <= node.mu], radius)
        yield from route(node.outside, fps, idx[d > node.mu - radius], radius)


def columns(b: pa.RecordBatch, n_words: int) -> np.ndarray:
    return np.stack([np.asarray(b.column(x)).view(np.uint64) for x in word_names(n_words)], axis=1) if b.num_rows else np.empty((0, n_words), np.uint64)


def taken(reps: DataFrame, n_words: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """About `sample_size` of the distinct fingerprints with their rows' ids: those whose hashes are low, the same ones however the data are laid out."""
    names = word_names(n_words)
    share = min(1.0, sample_size(total) / max(total, 1))
    t = reps.where(F.pmod(F.xxhash64(*names), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))).select("rep", *names).toArrow()
    fps = np.stack([t[x].to_numpy().view(np.uint64) for x in names], axis=1) if t.num_rows else np.empty((0, n_words), np.uint64)
    order = np.lexsort((t["rep"].to_numpy(), *fps.T))
    return t["rep"].to_numpy()[order], fps[order]


DEALT = "shard bigint, f0 bigint, near boolean, rep bigint"


def vp_dealt(reps: DataFrame, radius: int) -> DataFrame:
    """`reps` (f0, rep) dealt to shards, so that rows within `radius` bits meet in one.

    A row goes to each leaf of the vantage-point tree that its ball reaches, with its fingerprint. Rows of
    crowded leaves go to shards below zero by their neighbours' hashes, with the neighbour in place of the
    fingerprint; `near` is null for the others.
    """
    total = reps.count()
    _, sample = taken(reps, 1, total)
    tree, _ = plan_tree(sample[:, 0], total, radius)
    wide = len(masks(radius - radius // 2))
    crowd = sum(np.unique(np.concatenate([i for leaf, i in route(tree, sample[:, 0], np.arange(len(sample)), radius) if leaf.crowded] or [np.empty(0, int)])).shape)
    buckets = max(1, math.ceil(crowd * total / max(1, len(sample)) * wide / (64 * SHARD_ROWS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(shard: np.ndarray, f0: np.ndarray, near: pa.Array, rep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), pa.array(f0.view(np.int64)), near, pa.array(rep)], names=["shard", "f0", "near", "rep"])

        for b in batches:
            fps, rep = columns(b, 1)[:, 0], np.asarray(b.column("rep"))
            parts = list(route(tree, fps, np.arange(len(fps)), radius))
            for leaf, i in parts:
                if not leaf.crowded and len(i):
                    yield batch(np.full(len(i), leaf.shard), fps[i], pa.nulls(len(i), pa.bool_()), rep[i])
            crowded = np.unique(np.concatenate([i for leaf, i in parts if leaf.crowded] or [np.empty(0, int)]))
            step = max(1, LOOK_UP // wide)
            for at in range(0, len(crowded), step):
                i = crowded[at : at + step]
                keys, near = neighbour_keys(fps[i], radius)
                shard = -1 - (remixed(keys, 1) % np.uint64(buckets)).astype(np.int64)
                yield batch(shard.ravel(), keys.ravel(), pa.array(np.tile(near, len(i))), np.repeat(rep[i], wide))

    return with_code(reps.select("f0", "rep")).mapInArrow(deal, DEALT)


def vp_links(reps: DataFrame, radius: int) -> DataFrame:
    """(src, dst): what connects the distinct fingerprints `reps` (f0, rep) that differ in at most `radius` bits."""

    def solve(t: pa.Table) -> pa.Table:
        rep, f0 = t["rep"].to_numpy(), t["f0"].to_numpy().view(np.uint64)
        if t["near"].null_count:
            order = np.argsort(rep, kind="stable")
            forest = Forest(len(rep))
            link_tree(f0[order], radius, forest)
            return stars(rep[order], forest)
        ids, row = np.unique(rep, return_inverse=True)
        forest = Forest(len(ids))
        link_neighbours(f0, t["near"].to_numpy(), row, forest)
        return stars(ids, forest)

    return vp_dealt(reps, radius).groupBy("shard").applyInArrow(solve, "src bigint, dst bigint")


def first_word_links(reps: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(src, dst): what connects wide fingerprints whose first words differ in at most `radius` bits, exactly, by vantage-point shards."""
    firsts = scratch.table(reps.groupBy("f0").agg(F.min("rep").alias("rep")), "firsts")
    equal = reps.join(firsts.select(F.col("f0").alias("w"), F.col("rep").alias("dst")), F.col("f0") == F.col("w")).where("rep <> dst").select(F.col("rep").alias("src"), "dst")
    return vp_links(firsts, radius).unionByName(equal)


def stars(rep: np.ndarray, forest: Forest) -> pa.Table:
    root = forest.roots(np.arange(len(rep)))
    own = np.flatnonzero(root != np.arange(len(rep)))
    return pa.table({"src": pa.array(rep[own], pa.int64()), "dst": pa.array(rep[root[own]], pa.int64())})


def band_plan(total: int, p: float, recall: float) -> tuple[int, int]:
    """Bits of a band and bands, so that shards hold about SHARD_ROWS rows and a pair that differs in a share p of the bits meets with `recall`."""
    k = max(0, math.ceil(math.log2(max(1, total / SHARD_ROWS))))
    meet = (1 - p) ** k
    return k, 1 if k == 0 else math.ceil(math.log(1 - recall) / math.log(1 - meet))


def block_tasks(own: np.ndarray, near: np.ndarray, salt: np.ndarray, nears: int, fars: int) -> Iterator[tuple[int, np.ndarray]]:
    """The rows of each task of a hot group: a near group with a far group, or two far groups."""
    g = (salt % np.uint64(nears)).astype(np.int64)
    f = (salt % np.uint64(fars)).astype(np.int64)
    for j in range(fars):
        far = own[~near & (f == j)]
        for i in range(nears):
            yield i * fars + j, np.concatenate([own[near & (g == i)], far])
        for k in range(j):
            yield nears * fars + k * fars + j, np.concatenate([own[~near & (f == k)], far])


def band_links(reps: DataFrame, radius: int, n_words: int, recall: float = 0.99) -> DataFrame:
    """As vp_links, for radii at which no ball prunes: shards are samples of bits, several per row.

    A pair within `radius` shares at least one shard with probability `recall` (more, when it is closer).
    A bucket that the sample shows to be hot is split: its rows within `radius` of its hub are linked
    to the hub at once and need no comparison with one another. Those rows are dealt over near groups, the
    others over far groups, of SHARD_ROWS rows each; one task compares a near group with a far one, or two far
    ones, so a task's rows are bounded whatever a bucket holds.
    """
    total = reps.count()
    ids, sample = taken(reps, n_words, total)
    k, bands = band_plan(total, radius / (64 * n_words), recall)
    rng = np.random.default_rng(SEED)
    bits = [rng.choice(64 * n_words, k, replace=False) for _ in range(bands)]
    names = word_names(n_words)

    def keys(fps: np.ndarray, t: int) -> np.ndarray:
        key = np.zeros(len(fps), np.int64)
        for i, bit in enumerate(bits[t].tolist()):
            key |= ((fps[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(np.int64) << i
        return key

    hot: dict[tuple[int, int], tuple[np.ndarray, int, int, int]] = {}
    for t in range(bands):
        of, n_of = np.unique(keys(sample, t), return_counts=True)
        for key, n in zip(of.tolist(), n_of.tolist(), strict=True):
            if (rows := n * total / max(1, len(sample))) > 4 * SHARD_ROWS and n >= 16:
                own = np.flatnonzero(keys(sample, t) == key)[:1024]
                near = distances(sample[own], sample[own]) <= radius
                hub = near.sum(axis=1).argmax()
                share = near[hub].mean()
                hot[t, key] = (sample[own[hub]], int(ids[own[hub]]), math.ceil(share * rows / SHARD_ROWS), math.ceil(max(1, (1 - share) * rows) / SHARD_ROWS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, rep = columns(b, n_words), np.asarray(b.column("rep"))
            shard, idx, hub = [], [], []
            none = np.iinfo(np.int64).min
            for t in range(bands):
                key = keys(fps, t)
                plain = np.ones(len(key), bool)
                for (u, h), (centre, hub_id, nears, fars) in hot.items():
                    if u != t or not len(own := np.flatnonzero(key == h)):
                        continue
                    plain[own] = False
                    near = distances(fps[own], centre[None])[:, 0] <= radius
                    salt = remixed(rep[own].view(np.uint64), 1)
                    for task, into in block_tasks(own, near, salt, nears, fars):
                        shard.append(np.full(len(into), (((t << 28) + h) << 22) + 1 + task, np.int64))
                        idx.append(into)
                        hub.append(np.where(distances(fps[into], centre[None])[:, 0] <= radius, hub_id, none))
                own = np.flatnonzero(plain)
                shard.append(((t << 28) + key[own]) << 22)
                idx.append(own)
                hub.append(np.full(len(own), none))
            i = np.concatenate(idx)
            h = np.concatenate(hub)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shard)), *(pa.array(fps[i, w].view(np.int64)) for w in range(n_words)), pa.array(rep[i]), pa.array(h, mask=h == none)], names=["shard", *names, "rep", "hub"])

    def solve(t: pa.Table) -> pa.Table:
        rep = t["rep"].to_numpy()
        order = np.argsort(rep, kind="stable")
        fps = np.stack([t[x].to_numpy().view(np.uint64)[order] for x in names], axis=1)
        forest = Forest(len(rep))
        hub = t["hub"].combine_chunks().take(pa.array(order))
        linked = np.flatnonzero(~np.asarray(hub.is_null()))
        for i in linked[1:].tolist():
            forest.join(int(linked[0]), i)
        link_block(fps, np.arange(len(rep)), radius, forest)
        out = stars(rep[order], forest)
        if len(linked):
            out = pa.concat_tables([out, pa.table({"src": pa.array([int(rep[order][linked[0]])], pa.int64()), "dst": pa.array([hub[int(linked[0])].as_py()], pa.int64())})])
        return out

    dealt = with_code(reps.select(*names, "rep")).mapInArrow(deal, "shard bigint, " + ", ".join(f"{x} bigint" for x in names) + ", rep bigint, hub bigint")
    return dealt.groupBy("shard").applyInArrow(solve, "src bigint, dst bigint")


# --- verification ------------------------------------------------------------------------------


def similar(a: frozenset[int], b: frozenset[int], similarity: float) -> bool:
    """Whether two sets of shingles have this Jaccard similarity; empty sets are equal."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both >= similarity * (len(a) + len(b) - both)


def set_of(shingles: bytes) -> frozenset[int]:
    return frozenset(unpacked_set(shingles).tolist())


def join_similar(sets: list[np.ndarray], joined: np.ndarray, similarity: float, forest: Forest) -> None:
    """Join all pairs of sets (sorted distinct hashes) whose Jaccard similarity is `similarity` or more; pairs of rows in `joined`, which are connected, are not compared.

    Each hash has a list of the rows that hold it, and a row's common hashes with all earlier ones are counted from
    the lists of its own: the work follows what sets share, not the number of pairs. Rows in `joined` come last
    and are entered in no list.
    """
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([*sets, np.empty(0, np.uint64)])
    _, token = np.unique(flat, return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(size)])
    free = np.flatnonzero(~joined)
    number = np.full(len(sets), -1)
    number[free] = np.arange(len(free))
    row = np.repeat(number, size)
    held = row >= 0
    order = np.argsort(token[held], kind="stable")
    lists, of = row[held][order], token[held][order]
    start = np.searchsorted(of, np.arange(token.max() + 2 if len(token) else 1))  # rows in a list rise, so earlier ones are its first part
    filled = start[:-1].copy()
    empty = np.flatnonzero(size == 0)
    for i in empty[1:].tolist():
        forest.join(int(empty[0]), i)
    for i in [*free.tolist(), *np.flatnonzero(joined).tolist()]:
        own = token[ends[i] : ends[i + 1]]
        spans = [lists[a:b] for a, b in zip(start[own].tolist(), filled[own].tolist(), strict=True) if b > a]
        if spans:
            both = np.bincount(np.concatenate(spans), minlength=len(free))
            other = free[np.flatnonzero(both >= similarity * (size[i] + size[free] - both))]
            if size[i] and len(other):
                for j in np.unique(forest.roots(other[size[other] > 0])).tolist():
                    forest.join(i, j)
        if number[i] >= 0:
            filled[own] += 1


def verified_links(sets: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """(src, dst): what connects the rows of `sets` (label, rep, shingles) of a label whose shingles are that similar, exactly.

    A label's rows are compared in one task. Where they are too many, the rows similar to a hub (of a
    few, the one with most of them) are linked to it and need no comparison with one another. They are dealt
    over near groups, the others over far groups; a task compares a near group with a far one, or two far ones.
    """
    sizes = sets.groupBy(F.col("label").alias("of")).agg(F.count("*").alias("n")).where(F.col("n") > VERIFY_ROWS)
    sizes = scratch.table(sizes, "large")
    slot = F.pmod(F.xxhash64("rep"), F.lit(HUBS)).cast("int")
    large = sets.join(sizes, F.col("label") == F.col("of"))
    hubs = large.groupBy("label", slot.alias("slot")).agg(F.min(F.struct(F.xxhash64("rep").alias("h"), "rep", "shingles")).alias("x"))
    hubs = hubs.groupBy(F.col("label").alias("of")).agg(F.array_sort(F.collect_list(F.struct("slot", F.col("x.rep").alias("rep"), F.col("x.shingles").alias("shingles")))).alias("hubs"))
    hubs = scratch.table(hubs, "hubs")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[frozenset[int]]] = {}
        for b in batches:
            masks = []
            for i, label in enumerate(b.column("label").to_pylist()):
                if label not in known:
                    known = {label: [set_of(x["shingles"]) for x in b.column("hubs")[i].as_py()]}
                own = set_of(b.column("shingles")[i].as_py())
                masks.append([similar(own, x, similarity) for x in known[label]])
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("rep"), b.column("same"), pa.array(masks, pa.list_(pa.bool_()))], names=["label", "rep", "same", "near"])

    told = with_code(large.drop("of").join(hubs, F.col("label") == F.col("of")).select("label", "rep", "same", "shingles", "hubs")).mapInArrow(tell, "label bigint, rep bigint, same bigint, near array<boolean>")
    told = scratch.table(told, "told")
    counts = told.select("label", F.posexplode("near").alias("i", "y")).groupBy("label", "i").agg(F.sum(F.col("y").cast("int")).alias("n"))
    best = counts.groupBy(F.col("label").alias("of")).agg(F.max_by("i", F.struct("n", "i")).alias("best"))
    best = best.join(sizes, "of").join(hubs.select(F.col("of"), F.col("hubs.rep").alias("reps")), "of").select("of", "best", F.col("reps")[F.col("best")].alias("hub"))
    held = told.join(best, F.col("label") == F.col("of")).groupBy(F.col("of").alias("hof")).agg(F.sum(F.col("near")[F.col("best")].cast("int")).alias("n"), F.count("*").alias("all"))
    groups = lambda n: F.greatest(F.ceil(n / VERIFY_ROWS), F.lit(1)).cast("int")
    best = best.join(held, F.col("of") == F.col("hof")).select("of", "best", "hub", groups(F.col("n")).alias("nears"), groups(F.col("all") - F.col("n")).alias("fars"))
    marks = told.join(best, F.col("label") == F.col("of")).select(F.col("rep").alias("mrep"), F.col("same").alias("msame"), F.col("near")[F.col("best")].alias("near"), "nears", "fars", "hub")
    marks = scratch.table(marks.distinct(), "marks")
    joined = large.drop("of", "n").join(marks, (F.col("rep") == F.col("mrep")) & (F.col("same") == F.col("msame")))
    own = lambda n: F.pmod(F.xxhash64("rep", F.lit(1)), F.col(n)).cast("int")
    fars, far = F.col("fars"), own("fars")
    of_near = F.transform(F.sequence(F.lit(0), fars - 1), lambda j: own("nears") * fars + j)
    of_far = F.transform(F.sequence(F.lit(0), F.col("nears") - 1), lambda i: i * fars + far)
    others = F.filter(F.sequence(F.lit(0), fars - 1), lambda k: k != far)
    of_far = F.concat(of_far, F.transform(others, lambda k: F.col("nears") * fars + F.least(k, far) * fars + F.greatest(k, far)))
    blocks = F.when(F.col("near"), of_near).otherwise(of_far)
    dealt = joined.select("label", "rep", "shingles", F.when(F.col("near"), F.col("hub")).alias("hub"), F.explode(blocks).alias("block"))
    others = sets.join(sizes, F.col("label") == F.col("of"), "left_anti").select("label", "rep", "shingles", F.lit(None).cast("bigint").alias("hub"), F.lit(0).alias("block"))
    dealt = others.unionByName(dealt)

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        rep = t["rep"].to_numpy()
        hub = t["hub"].to_pylist()
        forest = Forest(len(rep))
        linked = [i for i, h in enumerate(hub) if h is not None]
        for i in linked[1:]:
            forest.join(linked[0], i)
        join_similar([unpacked_set(x) for x in t["shingles"].to_pylist()], np.array([h is not None for h in hub]), similarity, forest)
        out = stars(rep, forest)
        if linked:
            out = pa.concat_tables([out, pa.table({"src": pa.array([int(rep[linked[0]])], pa.int64()), "dst": pa.array([hub[linked[0]]], pa.int64())})])
        return out

    return with_code(dealt).groupBy("label", "block").applyInArrow(solve, "src bigint, dst bigint")


# --- the operator ------------------------------------------------------------------------------


#: Nodes of rows without an id: above all ids, which are below 2^62. `one_of_each` makes those from NO_ID on, `near_dedup` those from UNNAMED on.
NO_ID, UNNAMED = 1 << 62, 3 << 61


def made_node(base: int, *keys: Column) -> Column:
    return F.xxhash64(*keys).bitwiseAND(F.lit((1 << 61) - 1)).bitwiseOR(F.lit(base))


def repeats(own: DataFrame, reps: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """(src, dst): edges from each id that stands on rows with different keys to the representatives of all of them."""
    key = F.struct(*keys)
    again = own.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("again")).agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low <> high").select("again")
    again = scratch.table(again, "repeats")
    rows = own.join(again, F.col("doc_id") == F.col("again")).select("doc_id", *keys).distinct()
    to = reps.select("rep", *(F.col(x).alias(f"t{x}") for x in keys))
    return rows.join(to, [F.col(x) == F.col(f"t{x}") for x in keys]).select(F.col("doc_id").alias("src"), F.col("rep").alias("dst"))


def near_dedup(docs: DataFrame, scratch: Scratch, words: int = 5, radius: int = 56, n_words: int = 4, similarity: float = 0.8) -> DataFrame:
    """(doc_id, f0 ..., component_id): documents whose fingerprints differ in at most `radius` bits, transitively.

    Fingerprints of several words only propose pairs: of those, documents are linked whose sets of
    shingles have a Jaccard similarity of `similarity` or more, counted over all shingles, of whose hashes 40 bits are
    compared. At 0.8 a pair differs in 39 of 256 bits; 56 are three standard errors more.

    Rows with equal fingerprints (and equal sets, where sets count) are first reduced to one
    representative with the smallest doc_id.
    One-word fingerprints with a small radius (up to BALL bits) are searched exactly by vantage-point
    shards, as are the first words of wider ones, at FIRST_WORD bits. What those do not reach is proposed by samples
    of bits too, because at such radii the triangle bound excludes nothing; verification follows both.
    Of a pair at `radius` bits that meets, comparing first words first loses 3e-9.

    Defined cases: null and empty texts have fingerprint zero and link like any other; repeated rows
    share a component; rows that repeat a doc_id with different texts count as one document; ids are below 2^62; a
    row with a null doc_id links like any other and is labelled by the others' ids (null if there are none); an empty table gives an empty
    one; other columns are ignored.
    """
    names = word_names(n_words)
    exact = n_words > 1
    keys = [*names, "same"] if exact else names
    own = scratch.table(shingled(docs, words, n_words) if exact else fingerprints(docs, words, n_words), "fingerprints")
    made = made_node(UNNAMED, *(F.col(x) for x in keys))
    reps = scratch.table(own.groupBy(*keys).agg(F.coalesce(F.min("doc_id"), F.first(made)).alias("rep")), "representatives")
    if n_words == 1:
        links = vp_links(reps, radius) if radius <= BALL else band_links(reps, radius, n_words)
    else:
        links = first_word_links(reps, FIRST_WORD, scratch).unionByName(band_links(reps, radius, n_words))
    same_id = repeats(own, reps, keys, scratch)
    labels = connected_components(scratch.table(links if exact else links.unionByName(same_id), "links"), scratch)
    if exact:
        near = reps.join(labels, reps.rep == labels.node).select("rep", F.col("same").alias("rsame"), *(F.col(x).alias(f"r{x}") for x in names), "label")
        same_row = (F.coalesce("doc_id", made) == F.col("rep")) & (F.col("same") == F.col("rsame"))
        sets = own.join(near, [same_row, *(F.col(x) == F.col(f"r{x}") for x in names)]).select("label", "rep", "same", "shingles")
        links = verified_links(scratch.table(sets, "sets"), similarity, scratch).unionByName(same_id)
        labels = connected_components(scratch.table(links, "verified"), scratch)
    labelled = reps.join(labels, reps.rep == labels.node, "left").select(*(F.col(x).alias(f"r{x}") for x in keys), F.coalesce("label", "rep").alias("component_id"))
    labelled = labelled.withColumn("component_id", F.when(F.col("component_id") < F.lit(UNNAMED), F.col("component_id")))
    labelled = scratch.table(labelled, "labelled")
    return own.join(labelled, [F.col(x) == F.col(f"r{x}") for x in keys]).select("doc_id", *names, "component_id")


def one_of_each(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """Of each group of near copies one row, with all its columns: that of the smallest doc_id; options as for `near_dedup`.

    A row without an id takes part under one that is made of its text's hash and lies above all ordinary ones,
    so that of equal texts without ids one stays, and none of those that are near a document with an id.
    Of rows that share an id, the one stays whose text has the smallest MD5 (of equal texts, the one whose
    columns have the smallest hash); all of them count in near_dedup, so a near copy of any is one of the id.

    Defined cases: null and empty texts are near copies of one another; repeated rows leave one; an empty
    table gives an empty one; all columns pass through, whatever their names.

    Rows are combined by id before and after their shuffle, so a repeated id brings one row per task.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    p = free_prefix(docs)
    keyed = docs.withColumn(p + "node", F.coalesce(F.col("doc_id").cast("bigint"), made_node(NO_ID, text)))
    found = near_dedup(keyed.select(F.col(p + "node").alias("doc_id"), "text"), scratch, **options)
    kept = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept")).distinct()
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.md5(text.cast("binary")), F.xxhash64(*plain))
    one = keyed.groupBy(F.col(p + "node").alias("node")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), order).alias("row"))
    return one.join(kept, F.col("node") == F.col("kept"), "left_semi").select("row.*")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, 64 bits, links at two or fewer differing bits, over all of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = near_dedup(docs, Scratch(spark, "simhash"), words=3, radius=2, n_words=1)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
