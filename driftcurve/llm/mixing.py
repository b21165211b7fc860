"""Mixing sources by temperature: exponentiated token shares, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from driftcurve.llm.storage import Scratch, free_prefix

SEED = 42
#: Documents that a block should hold.
BLOCK_DOCS = 4096
MAX_REPETITION = 2.0
#: Exponents that one pass over the sources tries, and passes: five bisections a pass, as many as a double can tell apart.
TRIED, PASSES = 31, 11
#: Bits of a block's hash by which a source's blocks are put in order group by group.
ORDER_BITS = 10


@dataclass
class Sources:
    """What the choice of an exponent must know of the sources: their number of tokens in all, the least and the most of one, and sums over them.

    `sums` takes exponents and returns, for each, the sum over sources of p = (tokens / most) ^ exponent, and that of p ln p.
    """

    total: int
    least: int
    most: int
    sums: Callable[[list[float]], list[tuple[float, float]]]

    def entropies(self, exponents: list[float]) -> list[float]:
        return [math.log(z) - e / z for z, e in self.sums(exponents)]

    def repetitions(self, exponents: list[float], budget: int | None) -> list[float]:
        """How often the smallest source, the most often read one, is read; without a budget it follows from the largest's being read once."""
        less = [(self.most / self.least) ** (1 - a) for a in exponents]
        if budget is None:
            return less
        return [x * budget / (z * self.most) for x, (z, _) in zip(less, self.sums(exponents), strict=True)]


def of_list(tokens: list[int]) -> Sources:
    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        powers = [[(t / max(tokens)) ** a for t in tokens] for a in exponents]
        return [(sum(p), sum(x * math.log(x) for x in p)) for p in powers]

    return Sources(sum(tokens), min(tokens), max(tokens), sums)


def of_table(totals: DataFrame) -> Sources | None:
    """From a table of sources (total); only sums leave the executors. None for an empty one."""
    r = totals.agg(F.sum("total").alias("total"), F.min("total").alias("least"), F.max("total").alias("most")).first()
    if r["total"] is None:
        return None

    def sums(exponents: list[float]) -> list[tuple[float, float]]:
        powers = [F.pow(F.col("total") / F.lit(r["most"]), F.lit(a)) for a in exponents]
        exact = lambda x: F.sum(x.cast("decimal(38,20)")).cast("double")  # noqa: E731  the same however the sources are laid out
        got = totals.agg(*(exact(p) for p in powers), *(exact(p * F.log(p)) for p in powers)).first()
        return list(zip(got[: len(powers)], got[len(powers) :], strict=True))

    return Sources(int(r["total"]), r["least"], r["most"], sums)


def bisect(low: float, high: float, fit: Callable[[list[float]], list[bool]]) -> float:
    """The smallest exponent in [low, high] that fits, given that all above one that fits do. `fit` judges several at once."""
    if fit([low])[0]:
        return low
    for _ in range(PASSES):
        tried = [low + (high - low) * k / (TRIED + 1) for k in range(1, TRIED + 1)]
        low, high = next(((b, t) for b, t, y in zip([low, *tried], tried, fit(tried), strict=False) if y), (tried[-1], high))
    return high


def exponent_of(s: Sources, budget: int | None = None, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None) -> float:
    """The exponent of a mix, from 0 (uniform) to 1 (natural shares).

    It is the smallest at which no source is read more than `max_repetition` times and the weights'
    entropy (nats) is at most `target_entropy`. Without a `budget` the mix is the smallest that reads
    every source at least once.
    """
    exponent = 0.0
    if max_repetition is not None:
        if s.repetitions([1.0], budget)[0] > max_repetition * (1 + 1e-9):
            raise ValueError(f"no exponent keeps {budget} tokens within {max_repetition} readings of {s.total}")
        exponent = bisect(0.0, 1.0, lambda a: [x <= max_repetition for x in s.repetitions(a, budget)])
    if target_entropy is not None:
        if s.entropies([1.0])[0] > target_entropy + 1e-12:
            raise ValueError("the natural shares exceed the target entropy")
        exponent = max(exponent, bisect(0.0, 1.0, lambda a: [x <= target_entropy for x in s.entropies(a)]))
    return exponent


def planned_sources(totals: DataFrame, block_docs: int, **limits) -> DataFrame:
    """(source, total, blocks, weight, budget) for a table of sources (source, total, docs); limits as for `exponent_of`.

    Weights are exponentiated token shares, normalised; a source's budget is its weight's part of the mix.
    """
    s = of_table(totals)
    exponent = exponent_of(s, **limits) if s else 1.0
    power = F.pow(F.col("total") / F.lit(s.most if s else 1), F.lit(exponent))
    weight = power / F.lit(s.sums([exponent])[0][0] if s else 1.0)
    budget = limits.get("budget")
    if budget is None:
        tokens = F.greatest("total", F.floor(F.lit(s.most if s else 1) * power + 1e-6))
    else:
        tokens = F.floor(F.lit(budget) * weight + 1e-6)
    return totals.select("source", "total", F.ceil(F.col("docs") / block_docs).cast("bigint").alias("blocks"), weight.alias("weight"), tokens.cast("bigint").alias("budget"))


def cost(text: Column) -> Column:
    """Words of a text, one at least: what a document takes from its source's budget."""
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1)).cast("bigint")


@dataclass
class Mix:
    """A mix on tables: its documents dealt into blocks, the plan of sources, and what each epoch reads of each block."""

    dealt: DataFrame  # doc_id, source, tokens, block, h, within
    planned: DataFrame  # source, total, blocks, weight, budget
    epochs: DataFrame  # source, block, block_tokens, epoch, offset, weight, budget
    seed: int


def order_of(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"))


def prepare(docs: DataFrame, scratch: Scratch, budget: int | None = None, max_repetition: float | None = MAX_REPETITION, target_entropy: float | None = None, seed: int = SEED, block_docs: int = BLOCK_DOCS) -> Mix:
    """Deal each source's documents by hash into blocks of about `block_docs` and order the blocks anew for each epoch.

    Cumulative sums over documents stay within a block, those over blocks within a part of the blocks'
    hashes, and only 2 ** ORDER_BITS sums of parts are ordered by source: neither a source's documents nor its
    blocks meet in one task.
    """
    one = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), cost(F.col("text")).alias("tokens"))
    one = scratch.table(one.groupBy("doc_id", "source").agg(F.sum("tokens").alias("tokens")), "costs")
    totals = scratch.table(one.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("docs")), "totals")
    planned = scratch.table(planned_sources(totals, block_docs, budget=budget, max_repetition=max_repetition, target_entropy=target_entropy), "plan")

    p = planned.select(F.col("source").alias("__s"), "total", "blocks", "weight", "budget")
    dealt = one.join(p.select("__s", "blocks"), F.col("source").eqNullSafe(F.col("__s"))).select("doc_id", "source", "tokens", F.pmod(order_of(seed), F.col("blocks")).alias("block"), order_of(seed).alias("h"))
    w = W.partitionBy("source", "block").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    dealt = scratch.table(dealt.withColumn("within", F.coalesce(F.sum("tokens").over(w), F.lit(0))), "dealt")

    blocks = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("block_tokens")).join(p, F.col("source").eqNullSafe(F.col("__s")))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("budget") - 1) / F.col("total")).cast("int"))))
    blocks = scratch.table(blocks.withColumn("h", F.xxhash64(F.lit(seed), "epoch", "block")).withColumn("part", F.shiftright("h", 64 - ORDER_BITS)), "blocks")
    before = lambda of, order: F.coalesce(F.sum(of).over(W.partitionBy("source", "epoch", *(["part"] if order == "h" else [])).orderBy(order, *(["block"] if order == "h" else [])).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = blocks.groupBy("source", "epoch", "part").agg(F.sum("block_tokens").alias("n")).withColumn("start", before("n", "part"))
    parts = parts.select(F.col("source").alias("__ps"), F.col("epoch").alias("__pe"), F.col("part").alias("__pp"), "start")
    blocks = blocks.withColumn("inner", before("block_tokens", "h")).join(parts, F.col("source").eqNullSafe(F.col("__ps")) & (F.col("epoch") == F.col("__pe")) & (F.col("part") == F.col("__pp")))
    blocks = blocks.withColumn("offset", F.col("epoch") * F.col("total") + F.col("start") + F.col("inner"))
    return Mix(dealt, planned, scratch.table(blocks.select("source", "block", "block_tokens", "epoch", "offset", "weight", "budget"), "epochs"), seed)


def mix(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """(doc_id, source, tokens, epoch, block, position, weight): each reading of a document in the mix; options as for `prepare`.

    Each epoch reads all blocks of a source in an order of its own; within a block documents keep a
    hashed order; the last epoch stops where the source's budget ends, between two documents.
    `position` is the share of its source's budget read before a document: sorted by it, every prefix of
    the mix has the target weights.

    Defined cases: a null or empty text costs one token; a null source is a source of its own; rows that
    share doc_id and source count as one document with their summed cost, in different sources as
    different ones; null doc_ids are one document of their source; an empty table gives an empty mix;
    other columns are ignored.
    """
    m = prepare(docs, scratch, **options)
    e = m.epochs.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "epoch", "offset", "weight", "budget")
    read = m.dealt.join(e, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")))
    start = F.col("offset") + F.col("within")
    read = read.where(start + F.col("tokens") <= F.col("budget"))
    return read.select("doc_id", "source", "tokens", "epoch", "block", (start / F.col("budget")).alias("position"), "weight")


def mixed_documents(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """The documents of a mix with all their columns, once for each reading.

    How often a document is read follows from its source, its hash and one row for its block: the epochs
    that read the block whole, and where the one that stops within it stops. That table has a row for some
    thousands of documents, so the texts need not move to meet it.

    Defined cases: as for `mix`, but that every row counts: rows that share doc_id and source are each
    read as often as their document is; null texts stay null; an empty table gives an empty one; all
    columns pass through, whatever their names.
    """
    m = prepare(docs, scratch, **options)
    room = F.col("budget") - F.col("offset")
    whole, cut = room >= F.col("block_tokens"), (room > 0) & (room < F.col("block_tokens"))
    times = m.epochs.groupBy("source", "block").agg(F.count(F.when(whole, 1)).alias("times"), F.max(F.when(cut, room)).alias("room"))
    times = times.select(F.col("source").alias("__s"), F.col("block").alias("__b"), "times", "room")
    last = m.dealt.join(times.where("room IS NOT NULL"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")))
    last = last.where(F.col("within") + F.col("tokens") <= F.col("room")).groupBy(F.col("__s").alias("__cs"), F.col("__b").alias("__cb")).agg(F.max(F.struct("h", F.col("doc_id").isNotNull().alias("named"), "doc_id")).alias("__upto"))
    times = times.join(last, F.col("__s").eqNullSafe(F.col("__cs")) & (F.col("__b") == F.col("__cb")), "left")
    p = free_prefix(docs)
    own = lambda name: F.col(p + name)
    times = scratch.table(times.select(F.col("__s").alias(p + "s"), F.col("__b").alias(p + "b"), F.col("times").alias(p + "times"), F.col("__upto").alias(p + "upto")), "times")
    sizes = m.planned.select(F.col("source").alias(p + "source"), F.col("blocks").alias(p + "blocks"))

    h = order_of(m.seed)
    joined = docs.join(sizes, F.col("source").cast("string").eqNullSafe(own("source")))
    joined = joined.withColumn(p + "block", F.pmod(h, own("blocks")))
    joined = joined.join(times, F.col("source").cast("string").eqNullSafe(own("s")) & (own("block") == own("b")))
    doc = F.col("doc_id").cast("bigint")
    more = F.coalesce(F.struct(h.alias("h"), doc.isNotNull().alias("named"), doc.alias("doc_id")) <= own("upto"), F.lit(False))
    joined = joined.withColumn(p + "n", (own("times") + more.cast("int")).cast("int")).where(own("n") > 0)
    return joined.withColumn(p + "nth", F.explode(F.sequence(F.lit(1), own("n")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op3_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, every source read at least once and none more than twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, Scratch(spark, "mix"))
