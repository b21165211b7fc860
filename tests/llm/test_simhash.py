import hashlib
import time

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from driftcurve.llm import simhash as S
from driftcurve.llm.storage import Scratch

DOCS = "doc_id bigint, text string, lang string, rep string"


def brute_components(fps: list[int], ids: list[int], radius: int) -> list[int]:
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def plain_fingerprint(text, words):
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_is_the_majority_of_bits():
    for text in ("", None, "one", "One TWO three", "ÄRGER Ärger a b c d\tE\nf", "x " * 500 + "y"):
        assert int(S.fingerprint(S.shingle_hashes(text, 3))[0]) == plain_fingerprint(text, 3)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_tree_finds_the_components_of_all_pairs(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    fps = np.concatenate([base] + [base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (8, 2))])
    forest = S.Forest(len(fps))
    S.link_tree(fps, radius, forest, leaf=16)
    assert forest.roots(np.arange(len(fps))).tolist() == brute_components([int(x) for x in fps], list(range(len(fps))), radius)


def test_planned_shards_bring_every_close_pair_together(monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 32)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    fps = np.concatenate([base, base ^ np.uint64(5)])
    tree, n = S.plan_tree(fps[::2], len(fps), 2)
    assert n > 4
    seen = [set() for _ in fps]
    for leaf, idx in S.route(tree, fps, np.arange(len(fps)), 2):
        for i in idx.tolist():
            seen[i].add(leaf.shard)
    assert all(seen[i] & seen[i + 400] for i in range(400))


def test_near_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(40)]
    texts += [t.replace(t.split()[7], "zz", 1) for t in texts[:20]] + [texts[0], texts[0], "", None, "a", "a", "A"]
    ids = [7 * i + 3 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, None, "x") for i, t in zip(ids, texts, strict=True)], DOCS)
    got = S.near_dedup(docs, Scratch(spark, "t"), words=3, radius=2, n_words=1).toPandas().sort_values("doc_id")
    fps = [plain_fingerprint(t, 3) for t in texts]
    assert [x & (2**64 - 1) for x in got.f0] == fps
    assert got.component_id.tolist() == brute_components(fps, ids, 2)


def test_wide_fingerprints_find_similar_texts_and_leave_others(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 16)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(words, 250)) for _ in range(120)]
    near = [[*b[:100], "new", *b[101:]] for b in base[:60]]
    texts = [" ".join(t) for t in base + near]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = S.near_dedup(docs, Scratch(spark, "t")).toPandas().set_index("doc_id").component_id.sort_index()
    assert [got[i] for i in range(120)] == list(range(120))
    assert sum(got[120 + i] == i for i in range(60)) >= 59


def test_hot_bucket_is_split_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 16)
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(words, 300))
    texts = []
    for _ in range(200):
        t = list(base)
        t[int(rng.integers(300))] = "q" + str(rng.integers(10**6))
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(words, 300)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = S.near_dedup(docs, Scratch(spark, "t")).toPandas().set_index("doc_id").component_id.sort_index()
    assert set(got.loc[:199]) == {0}
    assert [got[i] for i in range(200, 260)] == list(range(200, 260))


def test_edge_cases(spark):
    empty = spark.createDataFrame([], DOCS)
    assert S.near_dedup(empty, Scratch(spark, "t"), 3, 2, 1).count() == 0
    long = "word " * 200_000
    rows = [(5, None, None, None), (2, "", "x", None), (None, "some text here", None, None), (9, "some text here", None, None), (9, "some text here", None, None), (4, long, None, None)]
    got = S.near_dedup(spark.createDataFrame(rows, DOCS), Scratch(spark, "t"), 3, 2, 1).toPandas()
    got = {(None if pd.isna(i) else int(i)): int(c) for i, c in zip(got.doc_id, got.component_id, strict=True)}
    assert got == {5: 2, 2: 2, None: 9, 9: 9, 4: 4}


def edited(rng, base, n, words):
    """A copy with n words replaced, far from one another: each takes five shingles away."""
    out = list(base)
    for i in range(n):
        out[10 + 12 * i] = f"q{rng.integers(10**9)}"
    return out


def test_wide_fingerprints_link_by_exact_similarity(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_ROWS", 64)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(5000)]
    base = [list(rng.choice(words, 254)) for _ in range(80)]  # 250 shingles; n edits: Jaccard (250 - 5n) / (250 + 5n)
    texts = base + [edited(rng, b, 5 if i < 40 else 7, words) for i, b in enumerate(base)]  # 0.818 and 0.754
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = S.near_dedup(docs, Scratch(spark, "t")).toPandas().set_index("doc_id").component_id.sort_index()
    assert [got[120 + i] for i in range(40)] == [120 + i for i in range(40)]
    assert sum(got[80 + i] == i for i in range(40)) >= 39


def test_large_groups_are_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "VERIFY_ROWS", 16)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(5000)]
    base = list(rng.choice(words, 254))
    texts = [edited(rng, base, 2, words) for _ in range(60)] + [edited(rng, base, 9, words) for _ in range(6)]
    sets = [frozenset(S.shingle_hashes(" ".join(t), 5).tolist()) for t in texts]
    rows = [(0, i, i, S.packed_set(np.array(sorted(s), np.uint64))) for i, s in enumerate(sets)]
    scratch = Scratch(spark, "t")
    links = S.verified_links(spark.createDataFrame(rows, "label bigint, rep bigint, same bigint, shingles binary"), 0.8, scratch).collect()
    forest, want = S.Forest(66), S.Forest(66)
    for r in links:
        forest.join(r.src, r.dst)
    for i in range(66):
        for j in range(i):
            if S.similar(sets[i], sets[j], 0.8):
                want.join(i, j)
    assert [forest.root(i) for i in range(66)] == [want.root(i) for i in range(66)]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_crowds_are_joined_by_neighbours(radius, monkeypatch):
    monkeypatch.setattr(S, "LOOK_UP", 1 << 14)
    rng = np.random.default_rng(8)
    fps = np.unique(crowd(rng, 3000, 4 if radius == 1 else 5))
    forest, want = S.Forest(len(fps)), S.Forest(len(fps))
    monkeypatch.setattr(S, "masks", lambda flips, f=S.masks: f(flips))
    S.link_crowd(fps, np.arange(len(fps)), radius, forest)
    S.link_block(fps[:, None], np.arange(len(fps)), radius, want)
    assert [forest.root(i) for i in range(len(fps))] == [want.root(i) for i in range(len(fps))]


def crowd(rng, n, flips):
    """Fingerprints at up to so many random flips from one centre."""
    out = np.full(n, 0x0123456789ABCDEF, np.uint64)
    for _ in range(flips):
        out ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    return out


def test_half_of_all_rows_around_one_centre(spark, monkeypatch):
    """Planning stays short, no shard grows with the crowd, and the components are those of brute force."""
    monkeypatch.setattr(S, "SHARD_ROWS", 256)
    rng = np.random.default_rng(9)
    fps = np.unique(np.concatenate([crowd(rng, 6000, 5), rng.integers(0, 2**63, 6000, dtype=np.int64).view(np.uint64)]))
    reps = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64).tolist())], "f0 bigint, rep bigint").select("f0", "rep")
    sizes = {r.shard: r.n for r in S.vp_dealt(reps, 2).groupBy("shard").count().withColumnRenamed("count", "n").collect()}
    assert max(n for s, n in sizes.items() if s >= 0) <= 4 * 256 and max(n for s, n in sizes.items() if s < 0) <= 2 * 64 * 256
    forest, want = S.Forest(len(fps)), S.Forest(len(fps))
    for r in S.vp_links(reps, 2).collect():
        forest.join(r.src, r.dst)
    S.link_block(fps[:, None], np.arange(len(fps)), 2, want)
    assert [forest.root(i) for i in range(len(fps))] == [want.root(i) for i in range(len(fps))]
    for flips in (4, 8):
        sample = np.concatenate([crowd(rng, 8192, flips), rng.integers(0, 2**63, 8192, dtype=np.int64).view(np.uint64)])
        began = time.process_time()
        _, n = S.plan_tree(sample, 200_000_000, 2)
        assert time.process_time() - began < 10 and n < 16 * 200_000_000 / S.shard_rows(200_000_000)


def test_rows_that_repeat_an_id_share_a_component(spark):
    rows = [(3, "alpha beta gamma delta"), (5, "alpha beta gamma delta"), (5, "some other text entirely here"), (7, "alpha beta gamma delta"), (8, "some other text entirely here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for options in ({"words": 3, "radius": 2, "n_words": 1}, {}):
        got = sorted((r.doc_id, r.component_id) for r in S.near_dedup(docs, Scratch(spark, "t"), **options).collect())
        assert got == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 3)]


@pytest.mark.parametrize(("nears", "fars"), [(1, 1), (3, 1), (2, 4)])
def test_tasks_of_a_hot_group_meet_all_pairs_but_near_ones(nears, fars):
    rng = np.random.default_rng(1)
    own = np.arange(60)
    near, salt = rng.random(60) < 0.5, rng.integers(0, 2**62, 60).astype(np.uint64)
    met = set()
    tasks = list(S.block_tasks(own, near, salt, nears, fars))
    assert len({k for k, _ in tasks}) == len(tasks)
    for _, rows in tasks:
        met |= {(int(a), int(b)) for a in rows for b in rows if a < b}
    assert all((a, b) in met for a in range(60) for b in range(a + 1, 60) if not (near[a] and near[b]))


def test_one_of_each_keeps_a_defined_row(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(5, "b text of its own", "x", 1), (5, "a text that differs", "y", 2), (9, "b text of its own", "z", 3), (None, long, "p", 4), (None, long, "q", 5), (None, "alone here", "r", 6), (7, long.replace("w3 ", "v "), "s", 7), (None, None, "t", 8), (8, "", "u", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, __kept int")
    want = min(("b text of its own", "a text that differs"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    for df in (docs, docs.repartition(5), docs.orderBy(F.desc("lang"))):
        got = S.one_of_each(df, Scratch(spark, "t"))
        assert got.columns == docs.columns
        assert sorted(((r.doc_id or 0), r.text) for r in got.collect()) == sorted([(5, want), (0, "alone here"), (7, rows[6][1]), (8, "")])
    assert S.one_of_each(docs.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("hub", [False, True])
def test_similar_sets_are_those_of_all_pairs(hub):
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, (6, 60))
    sets = [np.unique(np.concatenate([base[int(rng.integers(6))][: int(rng.integers(30, 61))], rng.integers(0, 2**63, int(rng.integers(0, 12)))])).astype(np.uint64) for _ in range(150)]
    sets += [np.empty(0, np.uint64)] * 3 + [sets[0], sets[1]]
    joined = np.zeros(len(sets), bool)
    forest, want = S.Forest(len(sets)), S.Forest(len(sets))
    if hub:
        joined[[i for i in range(len(sets)) if len(sets[i]) and S.similar(frozenset(sets[i].tolist()), frozenset(sets[5].tolist()), 0.8)]] = True
        for f in (forest, want):
            for i in np.flatnonzero(joined)[1:].tolist():
                f.join(int(np.flatnonzero(joined)[0]), i)
    S.join_similar(sets, joined, 0.8, forest)
    for i in range(len(sets)):
        for j in range(i):
            if S.similar(frozenset(sets[i].tolist()), frozenset(sets[j].tolist()), 0.8):
                want.join(i, j)
    assert [forest.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]
    S.join_similar([], np.empty(0, bool), 0.8, S.Forest(0))


def test_sets_in_bytes():
    rng = np.random.default_rng(12)
    h = np.unique(rng.integers(0, 2**63, 500).astype(np.uint64))
    assert S.unpacked_set(S.packed_set(h)).tolist() == sorted({int(x) & (1 << 8 * S.SET_BYTES) - 1 for x in h})
    assert len(S.packed_set(h)) == 500 * S.SET_BYTES and len(S.unpacked_set(S.packed_set(h[:0]))) == 0


def test_rows_without_ids_carry_links(spark):
    """A and B, B and C are near; B has no id, and its links count all the same."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words)]
    fp = lambda t: next(iter(S.fingerprints(spark.createDataFrame([(1, t)], "doc_id bigint, text string"), 3, 1).collect()))["f0"] & (2**64 - 1)
    base = fp(texts[0])
    tried = 0
    while len(texts) < 3 and tried < 400:
        more = texts[-1].split(" ")
        more[(tried * 37) % 400] += f"x{tried}"
        other, tried = " ".join(more), tried + 1
        far = [(fp(other) ^ fp(t)).bit_count() for t in texts]
        if far[-1] in (1, 2) and (len(texts) == 1 or far[0] > 2):
            texts.append(other)
    assert len(texts) == 3 and base
    for middle, want in ((None, {(1, 1), (None, 1), (3, 1)}), (2, {(1, 1), (2, 1), (3, 1)})):
        df = spark.createDataFrame([(1, texts[0]), (middle, texts[1]), (3, texts[2])], "doc_id bigint, text string")
        assert {(r.doc_id, r.component_id) for r in S.near_dedup(df, Scratch(spark, "t"), 3, 2, 1).collect()} == want
    alone = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (5, "other words here now")], "doc_id bigint, text string")
    assert {(r.doc_id, r.component_id) for r in S.near_dedup(alone, Scratch(spark, "t"), 3, 2, 1).collect()} == {(None, None), (5, 5)}


def test_columns_with_any_name_pass_through(spark):
    rows = [(1, "a b c d e f", 77, 88, 99), (2, "g h i j k l", 78, 89, 98)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __node int, node int, row int")
    assert sorted(map(tuple, S.one_of_each(df, Scratch(spark, "t")).collect())) == rows


def test_similar_documents_of_the_given_table_are_found(spark):
    """As the pipeline's stage: of all pairs of five-word sets at 0.8 or more, by brute force over shared shingles, 0.998 at least are in one component, and no component holds anything else."""
    from collections import Counter, defaultdict

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: set(S.shingle_hashes(r.text, 5).tolist()) for r in docs.collect()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for h in s:
            holders[h].append(i)
    forest, ids, pairs = S.Forest(len(sets)), {i: k for k, i in enumerate(sorted(sets))}, []
    for i, s in sets.items():
        shared = Counter(j for h in s for j in holders[h] if j > i)
        for j, n in shared.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                pairs.append((i, j))
                forest.join(ids[i], ids[j])
    blank = sorted(i for i, s in sets.items() if not s)
    for i in blank[1:]:
        forest.join(ids[blank[0]], ids[i])
    got = {r.doc_id: r.component_id for r in S.near_dedup(docs, Scratch(spark, "t")).select("doc_id", "component_id").collect()}
    assert len(pairs) > 1000 and sum(got[i] == got[j] for i, j in pairs) >= 0.998 * len(pairs)
    names = sorted(sets)
    assert all(names[forest.root(ids[i])] == names[forest.root(ids[c])] for i, c in got.items())


def test_wide_fingerprints_meet_in_vantage_point_shards(spark, monkeypatch):
    """Without samples of bits, near copies whose first words differ in at most two bits are still one document."""
    monkeypatch.setattr(S, "band_links", lambda reps, *_: spark.createDataFrame([], "src bigint, dst bigint"))
    rng = np.random.default_rng(5)
    base = [[f"w{i}" for i in rng.choice(3000, 250)] for _ in range(30)]
    texts = [" ".join(t) for t in [*base, *([*b, f"end{i}"] for i, b in enumerate(base))]]
    first = [int(S.fingerprint(S.shingle_hashes(t, 5))[0]) for t in texts]
    close = [i for i in range(30) if (first[i] ^ first[30 + i]).bit_count() <= 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in S.one_of_each(docs, Scratch(spark, "t")).collect()}
    assert len(close) > 15 and kept == {i for i in range(60) if i < 30 or i - 30 not in close}
