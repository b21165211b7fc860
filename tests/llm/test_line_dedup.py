from collections import Counter, defaultdict

import pytest

from driftcurve.llm import line_dedup as L
from driftcurve.llm.storage import Scratch

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, __pages int, n_lines_dropped string"


def run(spark, rows, **options):
    return L.line_dedup(spark.createDataFrame(rows, SCHEMA).drop("__pages"), Scratch(spark, "t"), **options)


def brute(rows, ratio=L.RATIO, least=L.MIN_PAGES):
    pages, seen = Counter(r[2] for r in rows), defaultdict(int)
    for r in rows:
        for line in {x.strip(" \t\r") for x in (r[1] or "").split("\n")} - {""}:
            seen[r[2], line] += 1
    gone = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for r in rows:
        keep = [x for x in (r[1] or "").split("\n") if (r[2], x.strip(" \t\r")) not in gone]
        out.append((r[0], None if r[1] is None else "\n".join(keep), 0 if r[1] is None else len(r[1].split("\n")) - len(keep)))
    return out


def test_equals_brute_force(spark):
    rows = []
    for i in range(120):
        s = "hot" if i % 3 else f"s{i % 5}"
        lines = [f"own {i}", " Menu\t" if i % 2 else "Menu", "", "Menu", f"pair {i // 20}"] + ["rare"] * (i % 30 == 0)
        rows.append((i, "\n".join(lines), s, 0, 0, "x"))
    rows += [(500, None, "hot", None, 0, None), (501, "Menu\nMenu", None, 9, 0, None), (7, rows[7][1], "hot", 0, 0, "x"), (7, rows[7][1], "hot", 0, 0, "x"), (None, "Menu\r\nkept", "hot", 0, 0, None)]
    got = run(spark, rows)
    assert got.columns == ["doc_id", "text", "source", "n_chars", "n_lines_dropped"]
    have = sorted(((r.doc_id, r.text, r.n_lines_dropped) for r in got.collect()), key=repr)
    assert have == sorted(brute(rows), key=repr)
    assert all(r.n_chars == len(r.text) for r in got.where("text IS NOT NULL").collect())


def test_long_text_with_many_lines(spark):
    long = "\n".join(f"line {i}" for i in range(100_000))
    rows = [(i, long if i == 0 else "line 5\nown", "a", 0, 0, None) for i in range(6)]
    got = {r.doc_id: r.text for r in run(spark, rows).collect()}
    assert got[0].count("\n") == 99_998 and got[1] == ""


@pytest.mark.parametrize("rows", [[], [(1, "", "a", 0, 0, None)], [(1, "only\nonly", "a", 0, 0, None)]])
def test_small_tables(spark, rows):
    assert [(r.doc_id, r.text, r.n_lines_dropped) for r in run(spark, rows).collect()] == brute(rows)


def test_columns_with_any_name_pass_through(spark):
    rows = [(i, "h", f"shared\nown {i}", 70 + i, 80 + i, 90 + i, 60 + i, 50 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string, __drop int, __text int, __hd int, ___left int, `a.b` int")
    got = sorted(map(tuple, L.line_dedup(df, Scratch(spark, "t")).collect()))
    assert got == [(i, "h", f"own {i}", 70 + i, 80 + i, 90 + i, 60 + i, 50 + i, 1) for i in range(3)]
