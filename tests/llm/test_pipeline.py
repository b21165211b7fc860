import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as C
from driftcurve.llm import line_dedup, mixing, pieces, quality, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(0)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 8))) for _ in range(2000)]
    line = lambda n=12: " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."
    texts = []
    for i in range(240):
        if i % 5 == 0:
            texts.append("\n".join(" ".join(w + rnd.choice(["%%%", "$$$"]) for w in line().split()) for _ in range(8)))
        else:
            texts.append("\n".join(["Subscribe to our letter."] * (i % 2) + [line() for _ in range(rnd.randrange(8, 14))]))
    for i in (1, 2, 3, 4):
        texts += [texts[i], texts[i].replace(texts[i].split()[20], "changed", 1)]
    rows = [(i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(240)], "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), rows


def brute(spark, sf_dir, rows):
    """The stages on plain Python lists, from the operators' scalar parts."""
    net = quality.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    docs = [r for r in rows if quality.probability(net, net.tables(), r[1]) >= 0.7]
    pages = Counter(r[3] for r in docs)
    seen = Counter((r[3], x) for r in docs for x in {x.strip(" \t\r") for x in r[1].split("\n")} - {""})
    boiler = {k for k, n in seen.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.RATIO * pages[k[0]]}
    docs = [(r[0], "\n".join(x for x in r[1].split("\n") if (r[3], x.strip(" \t\r")) not in boiler), r[3]) for r in docs]
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for _, t, _ in docs]
    label = [i for i, _, _ in docs]
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    for _ in docs:
        label = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(docs))]
    docs = [d for d, k in zip(docs, label, strict=True) if d[0] == k]
    cost = {i: max(1, len(t.split())) for i, t, _ in docs}
    totals = {s: sum(cost[i] for i, _, x in docs if x == s) for s in sorted({x for _, _, x in docs})}
    exponent, most = mixing.exponent_of(mixing.of_list(list(totals.values()))), max(totals.values())
    budgets = {s: max(t, int(most * (t / most) ** exponent + 1e-6)) for s, t in totals.items()}
    segmenter = pieces.Segmenter(pieces.read_model())
    return {i: segmenter.encode(t)[0].tolist() for i, t, _ in docs}, budgets, cost, {i: s for i, _, s in docs}


def test_run_equals_the_plain_version(spark, corpus):
    sf_dir, rows = corpus
    got = C.run(spark, sf_dir).collect()
    ids, budgets, cost, source = brute(spark, sf_dir, rows)
    assert {r.doc_id for r in got} == set(ids)
    assert all(r.round_trip and r.ids == ids[r.doc_id] for r in got)
    times = Counter(r.doc_id for r in got)
    for s, budget in budgets.items():
        read = sum(times[i] * cost[i] for i in ids if source[i] == s)
        assert budget - max(cost.values()) < read <= budget
    assert set(times.values()) <= {1, 2}


def test_stages_take_effect_and_keep_the_columns(spark, corpus):
    sf_dir, rows = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "source mixing", "sentencepiece encoding"]
    kept = C.classify(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & {i for i in range(240) if i % 5}) >= 190 and len(ids & set(range(0, 240, 5))) <= 2
    lines = C.drop_lines(spark, docs, sf_dir)
    assert lines.columns == docs.columns and lines.count() == len(rows)
    assert lines.where("doc_id < 240 AND text LIKE '%Subscribe to our letter.%'").count() == 0 and lines.where("n_chars <> length(text)").count() == 0
    near = C.drop_near_copies(spark, docs, sf_dir)
    assert near.columns == docs.columns
    assert {r.doc_id for r in near.collect()} == set(range(240))
    assert C.mix_sources(spark, docs, sf_dir).columns == docs.columns


@pytest.mark.parametrize("stage", [f for _, f in C.STAGES])
def test_stages_meet_odd_tables(spark, corpus, stage):
    sf_dir, _ = corpus
    schema = DOCS + ", component_id int, rep string"
    assert stage(spark, spark.createDataFrame([], schema), sf_dir).count() == 0
    rows = [(1, None, None, None, None, 1, "x"), (1, None, None, None, None, 1, "x"), (None, "some text", None, "a", 9, None, None), (None, "some text", None, "a", 9, None, None), (2, "", "en", "a", 0, 1, "x"), (3, "word and more " * 40_000, "en", "b", 560_000, 1, "x")]
    docs = spark.createDataFrame(rows, schema)
    got = stage(spark, docs, sf_dir)
    n = got.count()
    if stage is not C.encode:
        assert got.columns == docs.columns
    assert n <= 12 and (n == 6 or stage in (C.classify, C.drop_near_copies, C.mix_sources))
    if stage is C.drop_near_copies:
        assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 3]
