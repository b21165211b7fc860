"""Conversation repair against a search over all edit sequences, and against a plain dynamic programme on the given table."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest

from driftcurve.llm import repair as R
from driftcurve.llm.storage import Scratch

SCHEMA = "conv_id bigint, turn bigint, role string, text string, kind int, part string"


def plain_damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        if h == 2:
            text = re.sub("[.!?]", "", text)
        if h == 4:
            role = "user"
        out += [] if h == 0 else [(conv, turn, role, text)] * (2 if h == 3 else 1)
    return out


def plain_faults(own):
    seen, out = set(), []
    for _, _, role, text in own:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def spellings(role, fault):
    if fault in "bd":
        return [("D", 2, None)]
    more = 5 if fault == "t" else 0
    return [("D", 2, None), ("K", more, role), ("R", 1 + more, "user"), ("R", 1 + more, "assistant")]


def plain_repair(own):
    """Least (cost, audit) by a search from the end over (row, grammar state), in another way than the library's: strings grow to the left."""
    faults = plain_faults(own)
    nexts = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(maxsize=None)
    def best(i, state, inserts):
        found = []
        if i == len(own) and state in "0a":
            found.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if (state, role[0]) in nexts:
                    rest = best(i, nexts[state, role[0]], inserts + 1)
                    if rest:
                        found.append((5 + rest[0], "I" + rest[1], (f"{role}:", *rest[2])))
        if i < len(own):
            for label, cost, role in spellings(own[i][2], faults[i]):
                to = state if role is None else nexts.get((state, role[:1]))
                rest = to and best(i + 1, to, 0)
                if rest:
                    found.append((cost + rest[0], label + rest[1], (() if role is None else (f"{role}:{own[i][3]}",)) + rest[2]))
        return min(found) if found else None

    for i in range(len(own), -1, -1):
        for state in "0sua":
            for k in (3, 2, 1, 0):
                best(i, state, k)
    return best(0, "0", 0)


def plain_reports(rows, damage=True):
    after = plain_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, *_ in rows]
    out = []
    for conv in {r[0] for r in rows}:
        own = [r for r in after if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest()))
        faults = plain_faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = plain_repair(own)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, damage=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = R.repair_reports(R.damaged(df) if damage else R.as_they_are(df), Scratch(spark, "t")).collect()
    return sorted(map(tuple, got), key=str)


def talk(seed, n, roles=("system", "user", "assistant", "user", "assistant", "tool", "")):
    rng = random.Random(seed)
    return [(c, t, rng.choice(roles), rng.choice(["One. ", "Two!\n", "cut", " \t", "", "Drei?", f"r{rng.random()}."]), 1, "x") for c in range(n) for t in range(rng.randint(0, 9))]


@pytest.mark.parametrize("damage", [True, False])
def test_against_a_plain_search(spark, damage):
    rows = talk(1, 60)
    assert run(spark, rows, damage) == plain_reports(rows, damage)


def test_best_path_is_the_least_of_all_edit_sequences():
    rng = random.Random(2)
    rule = re.compile("(s?(ua)+)?")
    for _ in range(120):
        kinds = [(rng.choice("suau?"), rng.choice("---tbd")) for _ in range(rng.randint(0, 3))]
        found = []
        for gaps in itertools.product(range(3), repeat=len(kinds) + 1):
            if sum(gaps) > 3:
                continue
            options = [list(R.edits(*k)) for k in kinds]
            for chosen in itertools.product(*options):
                labels, cost = "I" * gaps[0], 5 * gaps[0]
                slots = ["ua"] * gaps[0]
                for (label, written, price), g in zip(chosen, gaps[1:], strict=True):
                    labels, cost = labels + label + "I" * g, cost + price + 5 * g
                    slots += ([written] if written else []) + ["ua"] * g
                if any(rule.fullmatch("".join(s)) for s in itertools.product(*slots)):
                    found.append((cost, labels))
        for cut in range(len(kinds) + 1):  # however the rows are cut into segments
            path = R.Path()
            for piece in (kinds[:cut], kinds[cut:]):
                if piece:
                    path.follow(R.segment_paths("".join(a + b for a, b in piece)))
            assert path.finish() == min(found)


def test_long_conversation_over_many_segments(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", f"{t}.", f"{t}?", ""]), 0, "") for t in range(3000)]
    rows += [(6, t, "user" if t % 2 == 0 else "assistant", f"{t}.", 0, "") for t in range(5)]
    assert run(spark, rows) == plain_reports(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "Hi.", 0, ""), (None, None, None, None, 0, ""), (1, None, "user", "A.", 0, ""), (1, None, "assistant", "B.", 0, ""), (1, 4, None, "C.", 0, ""), (1, 9, "assistant", None, 0, ""),
        (2, 3, "user", "Same.", 0, ""), (2, 3, "user", "Same.", 0, ""), (2, 3, "assistant", "Other.", 0, ""), (3, -(2**63), "user", "x.", 0, ""), (3, 2**63 - 1, "assistant", "y" * 300_000 + ".", 0, ""), (4, None, "system", "", 0, ""), (7, 1, "umbrella", "U.", 0, ""), (7, 2, "a", "A!", 0, ""),
    ]
    rows += [(8, 1, "user", "Copy.", 0, "")] * 400
    want = [r if r[1] < 2**63 else (r[0], 2**63 - 1, *r[2:]) for r in plain_reports(rows, False)]
    assert run(spark, rows, False) == want
    assert run(spark, rows) == [r if r[1] < 2**63 else (r[0], 2**63 - 1, *r[2:]) for r in plain_reports(rows)]
    dropped = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    assert run(spark, [(9, dropped, "user", "Gone.", 0, "")]) == [(9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert run(spark, []) == []


def test_mended_turns(spark):
    rows = [(1, 0, "user", "Hi.", 0, ""), (1, 1, "user", "There.", 0, ""), (2, 0, "system", "Rules.", 0, ""), (2, 1, "user", "Q?", 0, ""), (2, 2, "assistant", "", 0, "")]
    got = R.repaired_turns(R.as_they_are(spark.createDataFrame(rows, SCHEMA)), Scratch(spark, "t")).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got] == [(1, 1, "K", "user", "Hi."), (1, 2, "R", "assistant", "There."), (2, 1, "R", "user", "Rules."), (2, 2, "R", "assistant", "Q?")]


def test_query_over_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = R.op11_conversation_repair(spark, sf)
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == R.REPORT
    assert sorted(map(tuple, got.collect()), key=str) == plain_reports(rows)
