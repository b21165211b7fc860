"""Exact top-k search by inner product: a grid of query groups and vector shards, products tile by tile, lists merged in a tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from driftcurve.llm.storage import Scratch
from driftcurve.session import with_code

K = 10
#: Components become floor(SCALE * x).
SCALE = 1024
#: Queries are the rows whose id this divides.
EVERY = 100
#: The most bytes, at four a component, of one cell's queries and of one shard of vectors.
QUERY_BYTES, SHARD_BYTES = 32 << 20, 4 << 20
#: Queries and vectors of one matrix product.
TILE_QUERIES, TILE_VECTORS = 512, 4096
#: Lists that are merged into one at each level of the tree.
FAN = 16
#: Integers up to these are exact in the two floating-point types.
EXACT = ((1 << 24, np.float32), (1 << 53, np.float64))
LONG = np.iinfo(np.int64)


# --- in tasks -------------------------------------------------------------------------------------


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles, or as Python integers where a double no longer tells neighbours apart."""
    with np.errstate(over="ignore"):
        y = np.floor(x * float(SCALE))
    if np.abs(y).max(initial=0.0) < EXACT[1][0]:
        return y
    whole = lambda v: int(v) * SCALE if abs(v) >= EXACT[1][0] else math.floor(v * SCALE)
    return np.array([[whole(v) for v in row] for row in x.tolist()], dtype=object)


def norm(x: np.ndarray) -> float:
    """The greatest length of a row; no sum of products of two rows exceeds the product of their lengths."""
    if x.dtype == object:
        return math.inf
    big = np.abs(x).max(initial=0.0)
    return 0.0 if big == 0 else float(big * np.sqrt(((x / big) ** 2).sum(axis=1).max()))


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of the rows of a and b, in the narrowest type that holds them; those beyond a long are held at its ends."""
    for limit, kind in EXACT:
        if bound * 1.001 < limit:
            return a.astype(kind) @ b.astype(kind).T
    exact = a.astype(object) @ b.astype(object).T
    return np.vectorize(lambda v: min(max(int(v), LONG.min + 1), LONG.max), otypes=[np.int64])(exact)


class Lists:
    """For each of n queries its best k vectors so far, best first: the highest score, of equal ones the smallest id, no id twice."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), LONG.min, np.int64)
        self.vec = np.full((n, k), LONG.max, np.int64)
        self.size = np.zeros(n, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        """Merge (query, score, id) triples in."""
        if not len(query):
            return
        some = np.unique(query)
        held = np.arange(self.k)[None, :] < self.size[some, None]
        q = np.concatenate([np.repeat(some, self.size[some]), query])
        s, v = np.concatenate([self.score[some][held], score]), np.concatenate([self.vec[some][held], vec])
        order = np.lexsort((-s, v, q))  # of an id's scores the highest comes first and stays
        q, s, v = q[order], s[order], v[order]
        new = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])]
        q, s, v = q[new], s[new], v[new]
        order = np.lexsort((v, -s, q))
        q, s, v = q[order], s[order], v[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.score[q[keep], rank[keep]], self.vec[q[keep], rank[keep]] = s[keep], v[keep]
        self.size[some] = np.minimum(np.bincount(np.searchsorted(some, q), minlength=len(some)), self.k)

    def least(self) -> np.ndarray:
        """What a score must reach to enter; anything does while a list is short."""
        return np.where(self.size == self.k, self.score[:, -1], LONG.min)


def search_tile(lists: Lists, at: slice, ids: np.ndarray, queries: np.ndarray, vecs: np.ndarray, vectors: np.ndarray, bound: float) -> None:
    """One product of queries (rows `at` of the lists) and vectors (in the order of their ids), of which each query keeps what may enter its list."""
    s = products(queries, vectors, bound)
    first = np.r_[True, vecs[1:] != vecs[:-1]]
    if not first.all():  # rows that share an id count as their best
        s, vecs = np.maximum.reduceat(s, np.flatnonzero(first), axis=1), vecs[first]
    least = lists.least()[at]
    enters = s >= (least[:, None] if s.dtype == np.int64 else least[:, None].astype(np.float64))
    own = np.searchsorted(vecs, ids)
    is_own = (own < len(vecs)) & (vecs[np.minimum(own, len(vecs) - 1)] == ids)
    enters[np.flatnonzero(is_own), own[is_own]] = False
    many = enters.sum(axis=1) > 4 * lists.k
    for i in np.flatnonzero(many):  # partial selection: the k best, of equal ones those with the smallest ids
        c = np.flatnonzero(enters[i])
        edge = np.partition(s[i, c], len(c) - lists.k)[len(c) - lists.k]
        above, level = c[s[i, c] > edge], c[s[i, c] == edge]
        enters[i] = False
        enters[i, np.r_[above, level[: lists.k - len(above)]]] = True
    q, c = np.nonzero(enters)
    lists.add(q + at.start, s[q, c].astype(np.int64), vecs[c])


def search_cell(queries: dict[int, tuple[np.ndarray, np.ndarray]], lists: dict[int, Lists], dim: int, ids: np.ndarray, x: np.ndarray) -> None:
    """Vectors of one length against the cell's queries of that length, tile by tile."""
    if dim not in queries:
        return
    own, q = queries[dim]
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], scaled(x[order])
    longest = norm(q), norm(x)
    bound = math.inf if math.inf in longest else longest[0] * longest[1]
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    cuts = [0, *(int(c) for c in starts if c)]
    lo = 0
    while lo < len(ids):
        hi = next((c for c in reversed(cuts) if lo < c <= lo + TILE_VECTORS), len(ids)) if len(ids) - lo > TILE_VECTORS else len(ids)
        for k in range(0, len(own), TILE_QUERIES):
            at = slice(k, min(k + TILE_QUERIES, len(own)))
            search_tile(lists[dim], at, own[at], q[at], ids[lo:hi], x[lo:hi], bound)
        lo = hi


def by_length(ids: pa.Array, vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, ids, matrix) of a column of arrays of doubles."""
    sizes = np.diff(vectors.offsets.to_numpy())
    values = vectors.values.to_numpy(zero_copy_only=False)
    ids, starts = ids.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()[:-1]
    for dim in np.unique(sizes):
        own = np.flatnonzero(sizes == dim)
        yield int(dim), ids[own], values[starts[own][:, None] + np.arange(dim)]


def search_cells(k: int):
    """A function over Arrow batches sorted by (cell, kind): a cell's queries (kind 0) come first and are held, its vectors stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, shard = None, 0
        held: dict[int, list] = {}
        queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lists: dict[int, Lists] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for dim, found in lists.items():
                rows = np.arange(found.k)[None, :] < found.size[:, None]
                owner = np.repeat(queries[dim][0], found.size)
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.full(len(owner), shard)), pa.array(found.vec[rows]), pa.array(found.score[rows])], names=["query_id", "shard", "vec_id", "score"])

        for b in batches:
            cells, kinds, shards = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            ends = np.flatnonzero(np.r_[(cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1]), True]) + 1 if len(cells) else []
            lo = 0
            for hi in ends:
                if cells[lo] != cell:
                    yield from out()
                    cell, shard, held, queries, lists = cells[lo], shards[lo], {}, {}, {}
                parts = by_length(b.column(3).slice(lo, hi - lo), b.column(4).slice(lo, hi - lo))
                if kinds[lo] == 0:
                    for dim, ids, x in parts:
                        held.setdefault(dim, []).append((ids, x))
                elif held or queries:
                    if held:
                        queries = {d: (np.concatenate([i for i, _ in p]), scaled(np.concatenate([x for _, x in p]))) for d, p in held.items()}
                        lists, held = {d: Lists(len(i), k) for d, (i, _) in queries.items()}, {}
                    for dim, ids, x in parts:
                        search_cell(queries, lists, dim, ids, x)
                lo = hi
        yield from out()

    return run


# --- on tables ------------------------------------------------------------------------------------


def usable(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows with an id and a vector of finite components."""
    x = F.col(embedding).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.select(F.col(vec).cast("bigint").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & fine)


def merged(lists: DataFrame, k: int, *group: str) -> DataFrame:
    """The best k of each group's (vec_id, score), no id twice, with their rank; one shuffle."""
    best = lists.repartition("query_id", *group).groupBy("query_id", *group, "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id", *group).orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(queries: DataFrame, vectors: DataFrame, scratch: Scratch, k: int = K, query_bytes: int = QUERY_BYTES, shard_bytes: int = SHARD_BYTES, fan: int = FAN) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of `queries` (vec_id, embedding) the k best of `vectors` by integer inner product.

    Both sides are dealt out row by row, queries to groups of some `query_bytes`, vectors to shards of some
    `shard_bytes`; a cell of the grid compares one group with one shard. So each query travels once a shard and each
    vector once a group, however ids and vectors are spread, and a task holds one group's queries and one batch of
    vectors. The shards' lists of k are merged `fan` at a time, level by level.

    Defined cases: a vector that is null or holds null or non-finite components takes no part, nor does a row without
    an id; an empty vector scores 0 with other empty ones; vectors of different lengths have no product. A query does
    not meet rows of its own id. Rows that share an id are versions of one vector: two ids score the highest product of
    their versions, and a pair of ids comes once. Equal scores rank by id. Scores beyond a long are held at its ends. A
    query with fewer than k partners gets all of them, one without partners no row; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    deal = F.monotonically_increasing_id()
    own = scratch.table(usable(queries).withColumn("at", deal), "queries")
    every = scratch.table(usable(vectors).withColumn("at", deal), "vectors")
    size = lambda df: df.agg(F.coalesce(F.sum(4 * F.size("x") + 16), F.lit(0)).alias("n")).first()["n"]
    groups, shards = max(1, -(-size(own) // query_bytes)), max(1, -(-size(every) // shard_bytes))
    spread = lambda n: F.pmod(F.xxhash64("at"), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    q = own.withColumn("g", spread(groups)).withColumn("shard", all_of(shards)).withColumn("kind", F.lit(0))
    v = every.withColumn("shard", spread(shards)).withColumn("g", all_of(groups)).withColumn("kind", F.lit(1))
    cell = (F.col("g") * shards + F.col("shard")).alias("cell")
    both = q.select(cell, "kind", "shard", "vec_id", "x").unionByName(v.select(cell, "kind", "shard", "vec_id", "x"))
    parts = min(groups * shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups * shards // 8))
    both = both.repartition(parts, "cell").sortWithinPartitions("cell", "kind")
    lists = with_code(both).mapInArrow(search_cells(k), "query_id bigint, shard bigint, vec_id bigint, score bigint")
    while shards > fan:
        shards = -(-shards // fan)
        lists = merged(lists.withColumn("shard", F.floor(F.col("shard") / fan)), k, "shard").drop("rank")
    return merged(lists, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of each row of `embeddings` whose id is divisible by 100, among all other rows."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors, Scratch(spark, "top-k"))


OP12_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.x, c.x))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
  WHERE q.vec_id % 100 = 0
  GROUP BY ALL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
