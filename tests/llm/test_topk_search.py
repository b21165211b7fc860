"""Exact top-k search against all products in plain Python integers."""

import math
import random

import numpy as np
import pytest

from driftcurve.llm import topk_search as T
from driftcurve.llm.storage import Scratch

SCHEMA = "vec_id bigint, embedding array<double>, cell int, kind string"


def plain(rows, k=10, every=100):
    """All pairs of versions, as integers of any size."""
    fine = [(i, [math.floor(int(x) * 1024 if abs(x) >= 2**53 else x * 1024) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    best = {}
    for i, a in fine:
        for j, b in fine:
            if i % every == 0 and i != j and len(a) == len(b):
                s = min(max(sum(x * y for x, y in zip(a, b, strict=True)), -(2**63) + 1), 2**63 - 1)
                best[i, j] = max(s, best.get((i, j), s))
    out = []
    for q in {i for i, _ in best}:
        own = sorted((-s, j) for (i, j), s in best.items() if i == q)[:k]
        out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(own)]
    return sorted(out)


def run(spark, rows, k=10, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, T.top_k(df.where("vec_id % 100 = 0"), df, Scratch(spark, "t"), k, **kw).collect()))


@pytest.mark.parametrize("kw", [{}, {"query_bytes": 200, "shard_bytes": 600, "fan": 2}, {"query_bytes": 1, "shard_bytes": 5000, "fan": 3}])
def test_any_grid_and_tree_gives_all_products(spark, kw):
    rng = random.Random(5)
    rows = [(i * 25, [rng.uniform(-1, 1) for _ in range(6)], 1, "x") for i in range(60)]
    rows += [(7, rows[0][1], 0, None)] * 30 + [(i, [0.5] * 6, 0, None) for i in range(2000, 2040)]  # one row many times, many rows alike
    assert run(spark, rows, **kw) == plain(rows)


def test_odd_rows(spark):
    v = [0.1, -0.2, 0.3]
    rows = [
        (0, v, 0, ""), (0, [9.0, 0.0, 0.0], 0, ""), (100, [1.0, 1.0], 0, ""), (1, [2.0, -3.0], 0, ""), (2, None, 0, ""), (3, [1.0, None, 0.0], 0, ""), (4, [math.nan] * 3, 0, ""),
        (5, [math.inf, 0.0, 0.0], 0, ""), (None, v, 0, ""), (6, [], 0, ""), (200, [], 0, ""), (7, v, None, None), (7, v, 1, "a"), (8, [1e-300, 0.0, -1e-300], 0, ""), (300, None, 0, ""), (400, [1.0] * 5, 0, ""),
    ]
    got = run(spark, rows)
    assert got == plain(rows)
    assert [r for r in got if r[0] == 200] == [(200, 1, 6, 0)] and not [r for r in got if r[0] in (300, 400)]
    empty = spark.createDataFrame([], SCHEMA)
    assert T.top_k(empty, empty, Scratch(spark, "t")).count() == 0


def test_large_components_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i * 50, [rng.choice([1e3, 1e9, 1e15, 1e22, 1e308]) * rng.uniform(-1, 1) for _ in range(4)], 0, "") for i in range(12)]
    rows += [(i, [float(2**26 + i), -float(2**26), 1.0, 0.001 * i], 0, "") for i in (1, 2, 3)] + [(600, [float(2**26), float(2**26), 1.0, 1.0], 0, "")]
    assert run(spark, rows, 4) == plain(rows, 4)
    mild = [r for r in rows if r[0] in (1, 2, 3, 600)]
    assert run(spark, mild, 4) == plain(mild, 4)


def test_lists_merge_in_any_order():
    rng = np.random.default_rng(7)
    lists = T.Lists(5, 3)
    q, s, v = rng.integers(0, 5, 400), rng.integers(0, 30, 400), rng.integers(0, 50, 400)
    for i in range(0, 400, 37):
        lists.add(q[i : i + 37], s[i : i + 37], v[i : i + 37])
    for k in range(5):
        best = {}
        for a, b in zip(s[q == k].tolist(), v[q == k].tolist(), strict=True):
            best[b] = max(a, best.get(b, a))
        want = sorted((-a, b) for b, a in best.items())[:3]
        assert list(zip((-lists.score[k]).tolist(), lists.vec[k].tolist(), strict=True)) == want


def test_query_needs_no_pass_per_length(spark):
    rows = [(i, [1.0] * (i % 40 + 1), 0, "") for i in range(0, 400, 4)]
    assert run(spark, rows, shard_bytes=2000) == plain(rows)
