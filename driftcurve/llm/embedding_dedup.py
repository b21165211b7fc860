"""Embedding near-dedup with an inverted multi-index: a product grid of two codebooks, traversed nearest cells first."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftcurve.llm.components import connected_components
from driftcurve.llm.simhash import Forest
from driftcurve.llm.storage import Scratch
from driftcurve.session import with_code

SEED = 42
#: Vectors (at least, at most, and numbers in all) that codebooks and the traversal's width are fitted on.
LEAST_SAMPLE, SAMPLE, SAMPLE_NUMBERS = 1024, 16_384, 1 << 22
#: Vectors that a cell should hold, and the most centroids of a codebook: a grid for a billion vectors, whose cells grow from there on.
CELL_ROWS, MAX_CENTROIDS = 1024, 1024
#: What a task holds: vectors of a cell, and queries that visit it; a cell with more is compared by several tasks. Queries compared at once.
BLOCK_ROWS, QUERY_ROWS, CHUNK = 4096, 32_768, 512
THRESHOLD = 0.9
#: Vectors of one length that one task compares with each other.
FEW_ROWS = 64
#: The share of pairs at exactly the threshold that a traversal must meet; closer pairs are met more surely.
RECALL = 0.99


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; their largest components are brought near one first, by powers of two, so that no square is lost or infinite."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)[:, None] - 2 * x @ centres.T + np.einsum("ij,ij->i", centres, centres)


def codebook(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means, from rows drawn at random; a centroid that loses its rows stays where it is."""
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = squared(x, centres).argmin(axis=1)
        order = np.argsort(own, kind="stable")
        seen, first, n = np.unique(own[order], return_index=True, return_counts=True)
        centres[seen] = np.add.reduceat(x[order], first, axis=0) / n[:, None]
    return centres


@dataclass
class MultiIndex:
    """Codebooks over the halves of unit vectors. A cell (i, j) scores a vector by the sum of its halves' squared distances."""

    first: np.ndarray
    second: np.ndarray
    margin: float = 0.0  # a traversal goes on until a cell scores this much above the nearest one

    @property
    def half(self) -> int:
        return self.first.shape[1]

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return squared(x[:, : self.half], self.first), squared(x[:, self.half :], self.second)

    def home(self, x: np.ndarray) -> np.ndarray:
        d1, d2 = self.scores(x)
        return d1.argmin(axis=1) * len(self.second) + d2.argmin(axis=1)

    def reach(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First-half distances, second-half distances, and the score at which the traversal ends."""
        d1, d2 = self.scores(x)
        return d1, d2, d1.min(axis=1) + d2.min(axis=1) + self.margin

    def traverse(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (query, cell) pairs that the queries visit, each query's cells from the nearest on.

        Multi-sequence traversal: both halves' distances are sorted, so cells form a grid whose scores rise
        along rows and columns. Of each row the next cell not visited waits, from the row below the last
        one begun upwards; the least of those is visited, and its row moves on. All queries take their
        steps together; one that has passed its end leaves.
        """
        d1, d2, end = self.reach(x)
        o1, o2 = d1.argsort(axis=1, kind="stable"), d2.argsort(axis=1, kind="stable")
        s1 = np.take_along_axis(d1, o1, axis=1)
        s2 = np.pad(np.take_along_axis(d2, o2, axis=1), ((0, 0), (0, 1)), constant_values=np.inf)
        at = np.zeros(d1.shape, np.int32)  # each row's next cell
        begun = np.zeros(len(x), np.int64)  # rows begun
        live = np.arange(len(x))
        queries, cells = [], []
        while len(live):
            wide = min(int(begun[live].max()) + 1, s1.shape[1])
            waiting = s1[live, :wide] + s2[live[:, None], at[live, :wide]]
            waiting[np.arange(wide)[None, :] > begun[live, None]] = np.inf
            row = waiting.argmin(axis=1)
            on = waiting[np.arange(len(live)), row] <= end[live]
            live, row = live[on], row[on]
            column = at[live, row]
            queries.append(live)
            cells.append(o1[live, row] * len(self.second) + o2[live, column])
            begun[live] += column == 0
            at[live, row] += 1
        return np.concatenate([np.empty(0, np.int64), *queries]), np.concatenate([np.empty(0, np.int64), *cells])


def fit(sample: np.ndarray, total: int, threshold: float, recall: float) -> MultiIndex:
    """Codebooks on a sample of unit vectors, and the margin at which partners at exactly the threshold are met with `recall`.

    Partners at the threshold, the hardest ones, are made for the sample's rows by turning each by that
    angle in a random direction; linked pairs within the sample also count.
    """
    half = sample.shape[1] // 2
    k = int(np.clip(math.ceil(math.sqrt(total / CELL_ROWS)), 1, MAX_CENTROIDS))
    first, second = codebook(sample[:, :half], k), codebook(sample[:, half:], k)
    index = MultiIndex(first, second)
    rng = np.random.default_rng(SEED)
    x = sample[rng.choice(len(sample), min(4096, len(sample)), replace=False)]
    noise = rng.normal(size=x.shape)
    noise -= np.einsum("ij,ij->i", noise, x)[:, None] * x
    size = np.sqrt(np.einsum("ij,ij->i", noise, noise))[:, None]
    turned = threshold * x + math.sqrt(1 - threshold**2) * noise / np.where(size > 0, size, 1)
    over = [excess(index, x, turned)]
    at = x[:1024] @ sample.T >= threshold
    p, q = np.nonzero(at)
    if len(p):
        over.append(excess(index, x[p], sample[q]))
    index.margin = float(max(np.quantile(o, recall) for o in over)) + 1e-9
    if not math.isfinite(index.margin):
        raise ValueError("a vector without a finite direction came into the sample")
    return index


def excess(index: MultiIndex, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What a traversal's margin must be for x to reach y's cell or y to reach x's: the smaller of both."""
    d1x, d2x = index.scores(x)
    d1y, d2y = index.scores(y)
    r = np.arange(len(x))
    ax = d1x[r, d1y.argmin(axis=1)] + d2x[r, d2y.argmin(axis=1)] - d1x.min(axis=1) - d2x.min(axis=1)
    ay = d1y[r, d1x.argmin(axis=1)] + d2y[r, d2x.argmin(axis=1)] - d1y.min(axis=1) - d2y.min(axis=1)
    return np.minimum(ax, ay)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    return unit(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def solve_block(index: MultiIndex, home: np.ndarray, cell: np.ndarray, rep: np.ndarray, weight: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the vectors of a task that link: their ids, links found here and the smallest id they reach here.

    `home` marks the rows that lie in the task's cell; the others are queries that visit it, some for the same
    vectors. A pair that only one side's traversal meets is credited to both there, so that each link
    counts once a side.
    """
    ids, node = np.unique(rep, return_inverse=True)
    own, queries = np.flatnonzero(home), np.flatnonzero(~home)
    d1, d2, end = index.reach(x[own])
    links = np.zeros(len(ids), np.int64)
    forest = Forest(len(ids))
    for at in range(0, len(queries), CHUNK):
        p, h = np.nonzero(x[queries[at : at + CHUNK]] @ x[own].T >= threshold)
        p, q = queries[at + p], own[h]
        keep = node[p] != node[q]
        p, q, h = p[keep], q[keep], h[keep]
        if not len(p):
            continue
        np.add.at(links, node[p], weight[q])
        unseen = d1[h, cell[p] // len(index.second)] + d2[h, cell[p] % len(index.second)] > end[h]
        np.add.at(links, node[q[unseen]], weight[p[unseen]])
        roots = forest.roots(np.arange(len(ids)))
        a, b = roots[node[p]], roots[node[q]]
        for key in np.unique(np.minimum(a, b)[a != b] * len(ids) + np.maximum(a, b)[a != b]).tolist():
            forest.join(*divmod(key, len(ids)))
    roots = forest.roots(np.arange(len(ids)))
    found = np.flatnonzero((links > 0) | (roots != np.arange(len(ids))))
    return ids[found], links[found], ids[roots[found]]


def taken(vectors: DataFrame, dim: int, total: int) -> np.ndarray:
    """About as many unit vectors as the sample should have, those whose ids have low hashes: the same ones however the data are laid out."""
    bound = max(LEAST_SAMPLE, min(SAMPLE, SAMPLE_NUMBERS // dim))
    share = math.ceil(min(1.0, bound / max(total, 1)) * (1 << 30))
    rows = vectors.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < F.lit(share)).select("rep", "v").toArrow().sort_by("rep")
    return matrix(rows["v"].combine_chunks(), dim) if rows.num_rows else np.ones((1, dim)) / math.sqrt(dim)


def search(vectors: DataFrame, dim: int, scratch: Scratch, threshold: float, recall: float) -> DataFrame:
    """(rep, links, dst) over distinct vectors of one length: partial sums of links, and edges that connect them."""
    total = vectors.count()
    sample = taken(vectors, dim, total)
    index = fit(sample, total, threshold, recall)
    kind = vectors.schema["v"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = index.home(matrix(b.column("v"), dim)) if b.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.astype(np.int32))], names=[*b.schema.names, "cell"])

    placed = scratch.table(with_code(vectors.select("rep", "weight", "v")).mapInArrow(place, f"rep bigint, weight bigint, v {kind}, cell int"), f"placed-{dim}")
    counts = placed.groupBy("cell").agg(F.count("*").alias("n")).toArrow()  # at most MAX_CENTROIDS squared
    held = np.zeros(index.cells, np.int64)
    held[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    visits = np.bincount(index.traverse(sample)[1], minlength=index.cells) * (total / len(sample))
    blocks = np.ceil(held / BLOCK_ROWS).astype(np.int64)
    slices = np.ceil(np.maximum(visits, 1) / QUERY_ROWS).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(blocks * slices)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                own = np.asarray(part.column("cell"))
                salt = np.asarray(part.column("rep")).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                block = ((salt >> np.uint64(40)) % blocks[own].astype(np.uint64)).astype(np.int64)

                row, cell = index.traverse(matrix(part.column("v"), dim))
                mine = ((salt[row] >> np.uint64(16)) % slices[cell].astype(np.uint64)).astype(np.int64)
                row, cell, mine = (np.repeat(y, blocks[cell]) for y in (row, cell, mine))
                query = start[cell] + nth(row, cell) * slices[cell] + mine
                lies = np.repeat(np.arange(len(own)), slices[own])
                home = start[own[lies]] + block[lies] * slices[own[lies]] + nth(lies, own[lies])

                take = part.select(["rep", "weight", "v", "cell"]).take(pa.array(np.concatenate([row, lies])))
                tasks, homes = np.concatenate([query, home]), np.repeat([False, True], [len(query), len(home)])
                yield pa.RecordBatch.from_arrays([pa.array(tasks), pa.array(homes), *take.columns], names=["task", "home", "rep", "weight", "v", "cell"])

    def solve(t: pa.Table) -> pa.Table:
        x = matrix(t["v"].combine_chunks(), dim)
        rep, links, dst = solve_block(index, t["home"].to_numpy(zero_copy_only=False), t["cell"].to_numpy(), t["rep"].to_numpy(), t["weight"].to_numpy(), x, threshold)
        return pa.table({"rep": rep, "links": links, "dst": dst})

    dealt = with_code(placed).mapInArrow(deal, f"task bigint, home boolean, rep bigint, weight bigint, v {kind}, cell int")
    return dealt.groupBy("task").applyInArrow(solve, "rep bigint, links bigint, dst bigint")


def search_small(vectors: DataFrame, threshold: float) -> DataFrame:
    """As search, for lengths of at most FEW_ROWS vectors each: a length is one cell, and all of them are one job."""

    def solve(t: pa.Table) -> pa.Table:
        t = t.sort_by("rep")
        x = matrix(t["v"].combine_chunks(), t["dim"][0].as_py())
        rep, weight = t["rep"].to_numpy(), t["weight"].to_numpy()
        p, q = np.nonzero(x @ x.T >= threshold)
        p, q = p[p != q], q[p != q]
        links, forest = np.zeros(len(x), np.int64), Forest(len(x))
        np.add.at(links, p, weight[q])
        for i, j in zip(p.tolist(), q.tolist(), strict=True):
            forest.join(i, j)
        found = np.flatnonzero(links)
        return pa.table({"rep": rep[found], "links": links[found], "dst": rep[forest.roots(found)]})

    return with_code(vectors.select("rep", "weight", "v", "dim")).groupBy("dim").applyInArrow(solve, "rep bigint, links bigint, dst bigint")


def nth(*keys: np.ndarray) -> np.ndarray:
    """The place of each entry within its run of equal keys."""
    n = len(keys[0])
    if not n:
        return np.empty(0, np.int64)
    new = np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)])
    return np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))


def embedding_near_dedup(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Link vectors whose cosine reaches `threshold`: (vec_id, n_links, component_id, kept), one row per input row.

    Equal vectors are first reduced to one with a weight. The codebooks, and the margin after which a
    traversal ends, are fitted on at most SAMPLE vectors; every vector is indexed and every vector
    queries. A found pair is verified by its cosine in double precision, so no pair below the
    threshold links. A cell with many vectors or many visitors is compared by several tasks: its vectors
    in blocks of BLOCK_ROWS, the visitors in slices of about QUERY_ROWS.

    Defined cases: a vector that is null, empty, zero, or holds a null or a non-finite number has
    no links and is its own component; vectors of different lengths never link; rows that repeat a
    vec_id with equal vectors are linked copies, and with different vectors one node, so that all of
    them have one component; a null vec_id
    has no links and a null component; an empty table gives an empty one; other columns are ignored.
    """
    v = F.col("embedding")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False))) & F.col("vec_id").isNotNull()
    own = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.when(fine, v).alias("v"))
    keys = own.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("a"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit("v"), "v")).alias("b"), F.size("v").alias("dim"), "v")
    keys = scratch.table(keys, "vectors")
    reps = keys.where("v IS NOT NULL").groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("v").alias("v"), F.first("dim").alias("dim"))
    reps = scratch.table(reps, "distinct")
    common = [r["dim"] for r in reps.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > FEW_ROWS).collect()]
    found = None if reps.isEmpty() else search_small(reps.where(~F.col("dim").isin(common)), threshold)
    for dim in common:
        found = found.union(search(reps.where(F.col("dim") == dim), dim, scratch, threshold, recall))
    same_id = keys.where("vec_id IS NOT NULL").groupBy(F.col("vec_id").alias("again")).agg(F.min(F.struct("a", "b")).alias("low"), F.max(F.struct("a", "b")).alias("high")).where(~F.col("low").eqNullSafe(F.col("high"))).select("again")
    same_id = scratch.table(same_id, "repeats")
    if found is None:
        return own.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    found = scratch.table(found, "found")
    again = keys.join(same_id, F.col("vec_id") == F.col("again")).select("vec_id", "a", "b").distinct()
    again = again.join(reps.select(F.col("a").alias("ka"), F.col("b").alias("kb"), "rep"), (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")))
    edges = found.where("rep <> dst").select(F.col("rep").alias("src"), "dst").unionByName(again.select(F.col("vec_id").alias("src"), F.col("rep").alias("dst")))
    labels = connected_components(scratch.table(edges, "edges"), scratch)
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    known = reps.select("a", "b", "rep", "weight").join(sums, "rep", "left").join(labels, F.col("rep") == F.col("node"), "left")
    known = known.select(F.col("a").alias("ka"), F.col("b").alias("kb"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("label", "rep").alias("label"))
    known = scratch.table(known, "known")
    of_id = scratch.table(same_id.join(labels, F.col("again") == F.col("node")).select("again", F.col("label").alias("id_label")), "repeat-labels")
    joined = keys.drop("v").join(known, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")), "left").join(of_id, F.col("vec_id") == F.col("again"), "left")
    component = F.coalesce("id_label", "label", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of `embeddings`, whatever their labels."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return embedding_near_dedup(vectors, Scratch(spark, "embeddings"))


#: Every pair and its transitive closure: feasible on small tables only.
OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.9
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), n AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
), c AS (
  SELECT a, min(b) AS low FROM reach GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""
