"""Spelling variants against all pairs of a small vocabulary."""

import random
import re
import zlib
from collections import Counter

import pytest

from driftcurve.llm import variants as V
from driftcurve.llm.storage import Scratch


def plain_words(docs):
    seen = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(docs):
    n = plain_words(docs)
    out = {}
    for w in n:
        around = sorted((-n[v], v) for v in n if v != w and near(w, v))
        form = around[0][1] if around and -around[0][0] >= 5 * n[w] else None
        out[w] = (n[w], len(around), form, n[form] if form else None)
    rows = []
    for w, (c, k, form, fn) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows.append((w, c, k, form, fn, root))
    return sorted(rows)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id bigint, text string, word string, n int, key int").repartition(3)
    got = V.spelling_variants(df, Scratch(spark, "t"), **kw).select("word", "n", "n_near", "form", "form_n", "root").collect()
    return sorted(map(tuple, got))


def corpus(seed, words=40):
    """Families of words of few letters, at rising frequencies, so that near words, ties and chains are many."""
    rng = random.Random(seed)
    docs = []
    for _ in range(words):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        family = [w]
        for _ in range(5):
            v = list(rng.choice(family))
            k, kind = rng.randrange(len(v)), rng.randrange(3)
            v[k : k + 1] = [[], [rng.choice("abéÿ")], [v[k], rng.choice("abÿ")]][kind]
            family.append("".join(v))
        for v in family:
            docs += [v] * rng.choice([1, 5, 5, 6, 26, 130])
    for k in range(5):  # chains of three links
        docs += ["a" * k + "bcdefg"] * 8 + ["a" * k + "bcdefh"] * 45 + ["a" * k + "bcdehh"] * 240 + ["a" * k + "bcdehhi"] * 1300
    rng.shuffle(docs)
    return [(i, " ".join(docs[k : k + 20]).upper() if i % 3 == 0 else "-".join(docs[k : k + 20])) for i, k in enumerate(range(0, len(docs), 20))]


@pytest.mark.parametrize("kw", [{}, {"group_chars": 60, "tree_chars": 50}, {"group_chars": 1, "tree_chars": 1}])
def test_against_all_pairs(spark, kw):
    docs = corpus(1)
    got, want = run(spark, docs, **kw), plain(docs)
    assert got == want and sum(r[3] is not None for r in want) > 20 and sum(r[5] != r[3] for r in want if r[3]) > 2


def test_odd_texts(spark):
    long = "x" * 70_000
    docs = [(1, None), (2, ""), (3, "letter " * 30), (3, "letter " * 30), (None, "litter " * 6), (4, f"{long} " * 6), (5, f"{long}y " * 5), (6, "ÀBCDEFGH àbcdefgh " * 7), (7, "naïve_naïvely1naïvely " * 9), (8, "short " * 50)]
    got = run(spark, docs)
    assert got == plain(docs)
    kinds = {w[:8]: (n, k, form) for w, n, k, form, *_ in got}
    assert kinds["litter"] == (6, 1, "letter") and kinds["Àbcdefgh"] == (7, 1, None) and "short" not in kinds
    assert run(spark, [(1, None)]) == []


def test_equal_letters_in_a_row_count_once(spark):
    docs = [(1, "aaaaaa " * 5 + "aaaaaaa " * 6 + "aaaaaaab " * 7 + "baaaaaa " * 8)]
    assert run(spark, docs) == plain(docs)


def test_tree_reports_what_a_scan_finds():
    rng = random.Random(3)
    import numpy as np

    for n in (1, 2, 3, 17, 64, 100):
        values = np.array(rng.sample(range(n), n))
        tree = V.WaveletTree(values.copy())
        x = np.sort(np.array([[rng.randint(0, n), rng.randint(0, n)] for _ in range(50)]), axis=1)
        y = np.sort(np.array([[rng.randint(0, n), rng.randint(0, n)] for _ in range(50)]), axis=1)
        own, found = tree.report(x[:, 0], x[:, 1], y[:, 0], y[:, 1])
        want = {(i, int(v)) for i in range(50) for v in values[x[i, 0] : x[i, 1]] if y[i, 0] <= v < y[i, 1]}
        assert len(own) == len(want) and set(zip(own.tolist(), found.tolist(), strict=True)) == want


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = V.op13_spelling_variants(spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(docs)
    assert sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got.collect()) == want and len(want) > 100
