import random
import time
import tracemalloc

import pytest

from driftcurve.llm import pieces as P

SCHEMA = "doc_id bigint, text string, ids string"
TEXTS = ["", None, "hello world", "  two  spaces \n\nand\tbreaks \n ", "▁ literal ▁▁x", "ünïcödé 😀 漢字 ①ﬁ\u0000", " ", "\n", "a" * 300, "x  ", "  word\r\n"]


@pytest.fixture(scope="module")
def segmenter():
    return P.Segmenter(P.read_model())


def tiny():
    rnd = random.Random(0)
    alphabet = "ab "
    pieces = [(c.replace(" ", P.SPACE), -rnd.random() * 3, "normal") for c in alphabet]
    pieces += [(p, -rnd.random() * 6, "normal") for p in ("ab", "ba", "aab", "bb", P.SPACE + "a", P.SPACE + "ab", P.SPACE * 2, P.SPACE * 3)]
    return [("<unk>", 0.0, "other"), *((f"<0x{i:02X}>", 0.0, "byte") for i in range(256)), *pieces]


def every(s, text):
    """All segmentations of a text by plain recursion: {ids: score}."""
    scores = P.log_probabilities(tiny())
    table = {p.replace(P.SPACE, " "): i for i, (p, _, k) in enumerate(tiny()) if k == "normal"}
    out = {}

    def walk(rest, ids, score):
        if not rest:
            out[tuple(ids)] = score
        for piece, i in table.items():
            if rest.startswith(piece):
                walk(rest[len(piece) :], [*ids, i], score + scores[i])
        if rest and rest[0] not in table:
            b = [s.byte[x] for x in rest[0].encode()]
            walk(rest[1:], [*ids, *b], score + s.byte_score * len(b))

    walk(" " + text, [], 0.0)
    return out


@pytest.mark.parametrize("n", [1, 2, 5, 20])
def test_nbest_equals_all_segmentations_sorted(n):
    s = P.Segmenter(tiny())
    rnd = random.Random(n)
    for _ in range(40):
        text = "".join(rnd.choice("aabb  é\n") for _ in range(rnd.randrange(1, 9)))
        brute = every(s, text)
        got = s.nbest(text, n)
        assert [x for x, _ in got] == pytest.approx(sorted(brute.values(), reverse=True)[:n])
        assert len({tuple(i) for _, i in got}) == len(got)
        assert all(brute[tuple(i)] == pytest.approx(x) for x, i in got)
        assert all(s.decode(i) == text for _, i in got)


def test_second_best_gap_is_that_of_the_search(segmenter):
    for u in (" the", " segmentation", "xq", " Größe", "aaaa", "①"):
        two = segmenter.nbest_unit(u, 2)
        _, best, gap = segmenter.solve(u)
        assert best == pytest.approx(two[0][0])
        assert gap == pytest.approx(two[0][0] - two[1][0] if len(two) > 1 else float("inf"))


def test_round_trip_of_every_alternative(segmenter):
    for t in TEXTS:
        for _, ids in segmenter.nbest(t, 4):
            assert segmenter.decode(ids) == (t or "")


def test_units_join_to_the_text_and_no_piece_crosses_them(segmenter):
    for t in TEXTS:
        if t:
            assert "".join(segmenter.unit.findall(" " + t)) == " " + t
    assert segmenter.unit.findall(" a  b\n c ") == [" a", "  b", "\n", " c", " "]


def test_tables(spark):
    long = "Lorem ipsum dolor " * 20_000
    rows = [(i, t, None) for i, t in enumerate([*TEXTS, long])] + [(None, "a b", None), (2, "hello world", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = P.encode_documents(docs)
    out = got.collect()
    assert len(out) == len(rows) and all(r.round_trip and r.n_pieces == len(r.ids) and len(r.alternatives) <= 3 for r in out)
    assert all(r.ids == [] and r.score == 0 and r.alternatives == [] for r in out if r.doc_id in (0, 1))
    assert all(r.score >= r.alternatives[0].score >= r.alternatives[1].score for r in out if r.doc_id == 2)
    back = {r.doc_id: r.text for r in P.decode_documents(got).collect()}
    assert all(back[i] == (t or "") for i, t, _ in rows if i is not None)
    assert P.encode_documents(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1, 3, 8])
def test_nbest_of_ties_equals_all_segmentations(n):
    model = [("<unk>", 0.0, "other"), *((f"<0x{i:02X}>", 0.0, "byte") for i in range(256)), *((p, -1.0 * len(p), "normal") for p in (P.SPACE, "-", "--", "---", P.SPACE + "-"))]
    s = P.Segmenter(model)
    table = {p.replace(P.SPACE, " "): i for i, (p, _, k) in enumerate(model) if k == "normal"}

    def walk(rest):
        if not rest:
            return [()]
        return [(i, *tail) for p, i in table.items() if rest.startswith(p) for tail in walk(rest[len(p) :])]

    for k in range(1, 9):
        brute = walk(" " + "-" * k)
        got = s.nbest("-" * k, n)
        assert len(got) == min(n, len(brute)) == len({tuple(i) for _, i in got})
        assert all(tuple(i) in brute and x == pytest.approx(-1.0 - k) for x, i in got)


@pytest.mark.parametrize("text", ["-" * 20_000, "ab" * 10_000, "x☃" * 5_000])
def test_long_unbroken_units_take_bounded_time_and_memory(segmenter, text):
    segmenter.encode("warm")
    tracemalloc.start()
    began = time.process_time()
    ids, score, more = segmenter.encode(text)
    took, peak = time.process_time() - began, tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert segmenter.decode(ids) == text
    assert all(s <= score for s, _ in more)
    assert took < 20 and peak < 60e6  # seconds under tracing, on any machine
