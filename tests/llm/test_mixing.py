import math

import pytest

from driftcurve.llm import mixing as M
from driftcurve.llm.storage import Scratch

SCHEMA = "doc_id bigint, text string, source string, epoch string, total int"


def docs(spark, n=600):
    return spark.createDataFrame([(i, "w " * (1 + i * 7 % 40), "hot" if i % 3 else f"s{i % 7}", "x", 1) for i in range(n)], SCHEMA)


def plan(tokens, budget=None, **limits):
    """Weights and budgets of a list of sources, in plain Python, by a hundred bisections of the definition."""
    limits = {"max_repetition": M.MAX_REPETITION} | limits

    def at(a):
        raw = [(t / max(tokens)) ** a for t in tokens]
        w = [x / sum(raw) for x in raw]
        size = budget if budget is not None else max(t / x for t, x in zip(tokens, w, strict=True))
        return w, size, max(size * x / t for x, t in zip(w, tokens, strict=True)), -sum(x * math.log(x) for x in w)

    def fits(a):
        _, _, times, entropy = at(a)
        return times <= (limits["max_repetition"] or math.inf) and entropy <= (limits.get("target_entropy") or math.inf)

    low, high = 0.0, 1.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    exponent = 0.0 if fits(0.0) else high
    w, size, _, _ = at(exponent)
    return exponent, w, [max(t if budget is None else 0, math.floor(size * x + 1e-6)) for x, t in zip(w, tokens, strict=True)]


TOTALS = "source string, total bigint, docs bigint"


@pytest.mark.parametrize("limits", [{}, {"budget": 500}, {"budget": 1300, "max_repetition": 1.5}, {"budget": 500, "max_repetition": None, "target_entropy": 1.2}, {"target_entropy": 0.9}])
def test_plan_equals_plain_bisection(spark, limits):
    tokens = [1000, 300, 50, 10, 10]
    table = spark.createDataFrame([(f"s{i}", t, 5) for i, t in enumerate(tokens)], TOTALS)
    exponent, weights, budgets = plan(tokens, **limits)
    assert M.exponent_of(M.of_table(table), **limits) == pytest.approx(exponent, abs=1e-12)
    assert M.exponent_of(M.of_list(tokens), **limits) == pytest.approx(exponent, abs=1e-12)
    got = sorted(M.planned_sources(table, 2, **limits).collect(), key=lambda r: r.source)
    assert [r.weight for r in got] == pytest.approx(weights) and [r.budget for r in got] == budgets and [r.blocks for r in got] == [3] * 5


def test_exponent_meets_the_limits():
    tokens = [1000, 300, 50, 10]
    assert M.exponent_of(M.of_list(tokens)) == pytest.approx(1 - math.log(2) / math.log(100), abs=1e-6)
    s = M.of_list(tokens)
    a = M.exponent_of(s, budget=500, max_repetition=None, target_entropy=1.2)
    assert s.entropies([a])[0] == pytest.approx(1.2, abs=1e-9)
    with pytest.raises(ValueError):
        M.exponent_of(s, budget=5000, max_repetition=2.0)
    with pytest.raises(ValueError):
        M.exponent_of(s, target_entropy=0.1)


def test_many_sources_stay_on_the_executors(spark):
    table = spark.range(200_000).selectExpr("concat('s', id) AS source", "1 + id % 997 AS total", "1L AS docs")
    got = M.planned_sources(table, 10, target_entropy=12.05)
    r = got.selectExpr("count(*) AS n", "sum(weight) AS w", "-sum(weight * ln(weight)) AS h", "max(budget / total) AS times").first()
    assert r.n == 200_000 and r.w == pytest.approx(1) and r.h <= 12.05 + 1e-9 and r.times <= 2


@pytest.mark.parametrize("block_docs", [16, 4096])
@pytest.mark.parametrize("budget", [None, 4000])
def test_mix_equals_a_plain_walk(spark, block_docs, budget):
    df = docs(spark)
    got = M.mix(df, Scratch(spark, "t"), budget=budget, block_docs=block_docs).toPandas()
    cost = {r.doc_id: len(r.text.split()) for r in df.collect()}
    source = {r.doc_id: r.source for r in df.collect()}
    names = sorted(set(source.values()))
    totals = {s: sum(cost[i] for i in cost if source[i] == s) for s in names}
    _, _, budgets = plan([totals[s] for s in names], budget)
    for s, limit in zip(names, budgets, strict=True):
        own = got[got.source == s].sort_values("position")
        assert own.tokens.sum() <= limit < own.tokens.sum() + 40 * max(1, limit)
        for epoch, part in own.groupby("epoch"):
            assert part.doc_id.is_unique
            if (epoch + 1) * totals[s] <= limit:
                assert set(part.doc_id) == {i for i in cost if source[i] == s}
            at = epoch * totals[s] + part.tokens.cumsum() - part.tokens
            assert part.position.tolist() == pytest.approx((at / limit).tolist())
            blocks = part.block.tolist()
            assert sum(a != b for a, b in zip(blocks, blocks[1:], strict=False)) + 1 == len(set(blocks))
        if limit % totals[s] and len(own):  # the last epoch stops only where the next document would not fit
            rest = limit - own.tokens.sum()
            assert rest < 40
    again = M.mix(df.repartition(7), Scratch(spark, "t"), budget=budget, block_docs=block_docs).toPandas()
    key = ["doc_id", "epoch"]
    assert got.sort_values(key, ignore_index=True).equals(again.sort_values(key, ignore_index=True))


def test_every_prefix_has_the_weights(spark):
    got = M.mix(docs(spark, 3000), Scratch(spark, "t")).toPandas().sort_values("position")
    head = got.head(len(got) // 2)
    share = head.groupby("source").tokens.sum() / head.tokens.sum()
    for s, w in got.groupby("source").weight.first().items():
        assert share[s] == pytest.approx(w, abs=0.02)


def test_documents_come_back_once_a_reading(spark):
    df = docs(spark)
    got = M.mixed_documents(df, Scratch(spark, "t"))
    assert got.columns == df.columns
    assert got.select("doc_id").distinct().count() == 600
    for options in ({}, {"block_docs": 16}, {"budget": 4000, "block_docs": 16}, {"budget": 20_000}):
        times = M.mix(df, Scratch(spark, "t"), **options).groupBy("doc_id").count()
        assert sorted(map(tuple, times.collect())) == sorted(map(tuple, M.mixed_documents(df, Scratch(spark, "t"), **options).groupBy("doc_id").count().collect()))


def test_edge_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert M.mix(empty, Scratch(spark, "t")).count() == 0 and M.mixed_documents(empty, Scratch(spark, "t")).count() == 0
    rows = [(1, None, None, None, None), (2, "", "a", None, None), (2, "b c", "a", None, None), (None, "d", "b", None, None), (3, "x " * 100_000, "c", None, None)]
    odd = spark.createDataFrame(rows, SCHEMA)
    got = M.mix(odd, Scratch(spark, "t")).where("epoch = 0").collect()
    assert {(r.doc_id, r.source, r.tokens) for r in got} == {(1, None, 1), (2, "a", 3), (None, "b", 1), (3, "c", 100_000)}
    assert M.mixed_documents(odd, Scratch(spark, "t"), max_repetition=1.0).count() == 5
    assert M.mixed_documents(odd.union(odd), Scratch(spark, "t"), max_repetition=1.0).count() == 10


def test_columns_with_any_name_pass_through(spark):
    rows = [(i, f"s{i % 2}", f"some words {i}", 70 + i, 80 + i, 90 + i) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, __n int, __times int, block int")
    got = M.mixed_documents(df, Scratch(spark, "t")).distinct().collect()
    assert sorted(map(tuple, got)) == rows
