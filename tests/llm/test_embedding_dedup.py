import math

import numpy as np
import pandas as pd
import pytest

from driftcurve.llm import embedding_dedup as E
from driftcurve.llm.storage import Scratch

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep int"


def brute(x: np.ndarray, ids: list[int], threshold: float = 0.9):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = u @ u.T >= threshold
    np.fill_diagonal(at, False)
    label = np.array(ids)
    while True:
        new = np.minimum(label, np.where(at, label[None], label.max() + 1).min(axis=1))
        if (new == label).all():
            return at.sum(axis=1).tolist(), label.tolist()
        label = new


def run(spark, rows):
    got = E.embedding_near_dedup(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).toPandas()
    assert (got.kept == (got.vec_id == got.component_id)).all()
    return got.sort_values(["vec_id", "n_links"], ignore_index=True)


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_equals_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(E, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(E, "QUERY_ROWS", 3 * block_rows)
    monkeypatch.setattr(E, "CELL_ROWS", 8)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(500, 32))
    near = base[:150] + rng.normal(size=(150, 32)) * 0.3
    hot = base[0] + rng.normal(size=(200, 32)) * 0.15
    x = np.concatenate([base, near, hot, base[:20]]).astype(np.float32)
    ids = list(range(10, 10 + len(x)))
    got = run(spark, [(i, v.tolist(), None, None) for i, v in zip(ids, x, strict=True)])
    links, label = brute(x.astype(np.float64), ids)
    assert sum(got.n_links) >= 0.995 * sum(links)
    assert all(a <= b for a, b in zip(got.n_links, links, strict=True))
    assert sum(a == b for a, b in zip(got.component_id, label, strict=True)) >= 0.995 * len(label)


def test_a_link_that_one_side_meets_counts_for_both():
    rng = np.random.default_rng(1)
    x = E.unit(rng.normal(size=(400, 16)))
    index = E.fit(x, 400, 0.6, 0.5)
    index.margin = 0.05
    home = index.home(x)
    links = {i: 0 for i in range(400)}
    query, cell = index.traverse(x)
    for s in np.unique(home):
        visitors, lie = query[cell == s], np.flatnonzero(home == s)
        rows = np.concatenate([visitors, lie])
        here = np.repeat([False, True], [len(visitors), len(lie)])
        rep, n, _ = E.solve_block(index, here, home[rows], rows, np.ones(len(rows), int), x[rows], 0.6)
        for i, k in zip(rep.tolist(), n.tolist(), strict=True):
            links[i] += k
    at = x @ x.T >= 0.6
    visits = np.zeros((400, index.cells), bool)
    visits[query, cell] = True
    met = at & (visits[:, home] | visits[:, home].T)
    np.fill_diagonal(met, False)
    assert met.any() and (met != at).any()
    assert [links[i] for i in range(400)] == met.sum(axis=1).tolist()


def test_traversal_visits_the_nearest_cells_in_order():
    rng = np.random.default_rng(2)
    x = E.unit(rng.normal(size=(300, 24)))
    index = E.MultiIndex(E.codebook(x[:, :12], 9), E.codebook(x[:, 12:], 7), 0.2)
    query, cell = index.traverse(x)
    d1, d2, end = index.reach(x)
    score = (d1[:, :, None] + d2[:, None, :]).reshape(300, -1)
    for i in range(300):
        own = cell[query == i]
        assert sorted(own.tolist()) == np.flatnonzero(score[i] <= end[i]).tolist()
        assert (np.diff(score[i][own]) >= 0).all() and own[0] == index.home(x)[i]
    assert all(len(y) == 0 for y in index.traverse(x[:0]))


def test_rows_that_repeat_an_id_share_a_component(spark):
    v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    got = run(spark, [(3, v, 0, 0), (5, v, 0, 0), (5, w, 0, 0), (7, w, 0, 0), (9, None, 0, 0), (9, w, 0, 0), (11, w, 0, 0), (11, w, 0, 0)])
    assert got.component_id.tolist() == [3] * 8 and got.kept.tolist() == [True] + [False] * 7


def test_query_recall_on_whole_tables(spark):
    """All of a larger table against brute force in blocks; no pair below the threshold, recall of links and components."""
    sf = "/root/testdata/sf0.1"
    got = E.op9_embedding_near_dedup(spark, sf).toPandas().sort_values("vec_id", ignore_index=True)
    own = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id", ignore_index=True)
    fine = own.embedding.map(lambda v: v is not None and len(v) > 0 and bool(np.isfinite(np.array(v, float)).all()) and bool(np.any(v)))
    x = E.unit(np.array(own.embedding[fine].tolist(), float))
    at = np.concatenate([(x[i : i + 500] @ x.T >= 0.9).sum(axis=1) - 1 for i in range(0, len(x), 500)])
    n = got.n_links[fine].to_numpy()
    assert got.vec_id.tolist() == own.vec_id.tolist() and (got.n_links[~fine] == 0).all()
    assert (n <= at).all() and n.sum() >= 0.99 * at.sum() and (n == at).mean() >= 0.99


def test_edge_cases(spark):
    assert E.embedding_near_dedup(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, None, 1, 1), (2, [], 1, 1), (3, [0.0] * 4, 1, 1), (4, [1.0, None, 1.0, 1.0], 1, 1), (5, [math.nan, 1.0, 1.0, 1.0], 1, 1), (6, [math.inf, 1.0, 1.0, 1.0], 1, 1), (9, v, 1, 1), (8, v, 2, 1), (9, v, 1, 1), (7, [2 * a for a in v], None, None), (10, [1.0, 2.0, 3.0], 0, 0), (None, v, 0, 0)]
    got = run(spark, rows)
    seen = {(None if i != i else int(i), int(n), None if c != c else int(c)) for i, n, c in zip(got.vec_id, got.n_links, got.component_id, strict=True)}
    assert seen == {(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 10)} | {(7, 3, 7), (8, 3, 7), (9, 3, 7), (None, 0, None)}
    assert E.embedding_near_dedup(spark.createDataFrame(rows[:6], SCHEMA), Scratch(spark, "t")).where("n_links = 0 AND kept").count() == 6


def test_sizes_of_vectors_do_not_matter(spark):
    """Twenty linked pairs, and vectors so small or large that their squares are none; each scale links with itself alone by direction."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(70, 8))
    rows = [(2 * i, x[i].tolist(), 0, 0) for i in range(70)] + [(2 * i + 1, (x[i] * s).tolist(), 0, 0) for i, s in enumerate([1.5, 3.0, 1e-200, 1e200, 1e-310, 5e306, 0.5] * 10)]
    rows += [(1000, [1e-200] * 8, 0, 0), (1001, [2e-200] * 8, 0, 0), (1002, [1e200] * 8, 0, 0), (1003, [5e-324] * 8, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA.replace("float", "double")).repartition(3)
    got = E.embedding_near_dedup(df, Scratch(spark, "t")).toPandas().set_index("vec_id")
    v = E.unit(np.array([r[1] for r in rows]))
    want = (v @ v.T >= 0.9).sum(axis=1) - 1
    assert np.isfinite(v).all() and got.n_links[[r[0] for r in rows]].tolist() == want.tolist() and got.n_links[1003] >= 3


def test_many_lengths_are_one_job(spark, monkeypatch):
    calls, real = [], E.search
    monkeypatch.setattr(E, "search", lambda *a: calls.append(a[1]) or real(*a))
    rows = [(100 * d + k, [1.0 + (k == 2) * i for i in range(d)], 0, 0) for d in range(2, 30) for k in range(3)]
    rows += [(10_000 + i, np.random.default_rng(i).normal(size=5).tolist(), 0, 0) for i in range(80)]
    got = run(spark, rows).set_index("vec_id")
    assert calls == [5] and all(got.n_links[100 * d] >= 1 and got.component_id[100 * d + 1] == got.component_id[100 * d] for d in range(2, 30))


def test_recall_on_many_made_vectors(spark):
    """50,000 vectors in 32 dimensions, a tenth of them near another: at least nine tenths of all links are found, none that is not there."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50_000, 32))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    noise = rng.normal(size=(5000, 32))
    noise -= (noise * x[:5000]).sum(axis=1)[:, None] * x[:5000]
    noise /= np.sqrt((noise**2).sum(axis=1))[:, None]
    cosine = rng.uniform(0.9, 0.99, 5000)[:, None]
    x[5000:10_000] = cosine * x[:5000] + np.sqrt(1 - cosine**2) * noise
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(50_000), "embedding": x.tolist()})).repartition(8)
    got = E.embedding_near_dedup(df, Scratch(spark, "t")).toPandas().sort_values("vec_id", ignore_index=True)
    at = np.concatenate([(E.unit(x[i : i + 1000]) @ E.unit(x).T >= 0.9).sum(axis=1) - 1 for i in range(0, 50_000, 1000)])
    n = got.n_links.to_numpy()
    assert (n <= at).all() and n.sum() >= 0.95 * at.sum() > 9000
