import hashlib
import math
import random
import re

import pytest

from driftcurve.llm import pii as P
from driftcurve.llm.storage import Scratch
from pyspark.sql import functions as F

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(s))) % 10 == 0


def passes(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


CASES = [
    "", None, "no data here", "write to ann.b-c@mail.example.com, or a@b.c@d.e and x@y", "a@b.co_m@x.com..z@q-.r 1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.0255 0000255.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4041894974608795 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "+1 (988) 555-2485 +49.30.1234567- +1 +12 +123456789012345678 ++1 23456789 (", "\U0001f600 ünï 😀 é@b.de 😀+4912345678901 1.1.1.1😀", "@@@ @a.b x@-.- ...@a.b",
    "tel 555-123-4567, (212) 555-0188; version 1.2.3.4; mail joe (at) site (dot) com; fe80:0:0:0:1:2:3:4",
    "a" * 5000 + "@" + "b.c" * 300 + " " + "1 " * 9000 + "7" * 4000 + ".1" * 2000 + " +" + "1 (" * 3000, "a@b.cc " * 700 + "4111111111111111\n" * 400,
]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, found string, base int")
    got = P.find_personal_data(df, Scratch(spark, "t"))
    return got.select("doc_id", P.listing(F.col("base")).alias("base"), P.listing(F.concat("base", "added")).alias("spans")).collect()


def test_base_spans_equal_the_plain_patterns(spark):
    got = {r.doc_id: r for r in run(spark, [(i, t, None, 1) for i, t in enumerate(CASES)])}
    for i, t in enumerate(CASES):
        assert got[i].base == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)), i
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(",")), i


def test_random_texts(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("aB1234567890..@+-() é\n%_") for _ in range(rnd.randrange(400))) for _ in range(300)]
    got = {r.doc_id: r.base for r in run(spark, [(i, t, None, 1) for i, t in enumerate(texts)])}
    assert all(got[i] == ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)) for i, t in enumerate(texts))


def test_votes_add_likely_spans_and_leave_others(spark):
    rows = [(i, f"call +1 (212) 555-{1000 + i} or mail u{i}@site.com", None, 1) for i in range(200)]
    rows += [(1000, "please call 212 555 0199 today", None, 1), (1001, "section 212 555 0199 of the order no", None, 1), (1002, "nothing 12 here 2024-05-06 version 1.2.3", None, 1)]
    got = {r.doc_id: r for r in run(spark, rows)}
    assert got[1000].spans == "phone:12:24"
    assert got[1001].spans == "" and got[1002].spans == ""


def test_em_finds_the_unreliable_labelers():
    rnd = random.Random(2)
    rates = [(0.95, 0.05), (0.9, 0.1), (0.99, 0.97), (0.55, 0.45), (0.85, 0.3)]  # the third says yes to everything, the fourth guesses
    seen: dict = {}
    for _ in range(6000):
        y, strict = rnd.random() < 0.4, rnd.random() < 0.5
        v = tuple(1 if rnd.random() < (t if y else f) else -1 for t, f in rates)
        seen[v, strict] = seen.get((v, strict), 0) + 1
    trust, _ = P.reliabilities([(v, s, n) for (v, s), n in seen.items()])
    assert all(abs(p - 0.4) < 0.05 for p in trust.prior.values())
    assert all(abs(a - b) < 0.06 for got, k in ((trust.yes_if_true, 0), (trust.yes_if_false, 1)) for a, b in zip(got, (r[k] for r in rates), strict=True))


# --- the added spans by brute force -----------------------------------------------------------------


def mod97(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def plain_votes(kind, strict, ok, m, before, after):
    value, digits = m.lower(), re.sub("[^0-9]", "", m)
    sign = lambda c: 1 if c else -1
    form = sign(re.search("[A-Za-z]", m) and len(digits) >= 3) if kind == "secret" else (sign(ok) if strict else 0)
    check = {
        "email": lambda: sign(6 <= len(value) <= 254), "ip": lambda: sign(ok) if strict else sign(re.search("[0-9]", m) and len(re.split(":+", m)) <= 8),
        "card": lambda: sign(13 <= len(digits) <= 19 and luhn(digits)), "phone": lambda: sign(9 <= len(digits) <= 15), "secret": lambda: sign(len(set(m)) >= 10), "iban": lambda: sign(mod97(m) == 1),
    }[kind]()
    listed = {
        "email": lambda: sign((re.search("([a-z]+)$", value) or ["", ""])[1] in P.TLDS), "ip": lambda: sign(not value.startswith(P.UNROUTABLE)), "card": lambda: sign(digits.startswith(P.ISSUERS)),
        "phone": lambda: sign(not digits.startswith("0") and len(set(digits)) > 1), "secret": lambda: int(m.startswith(P.KEY_STARTS) or bool(re.fullmatch("[0-9A-Fa-f]+", m)) and len(m) in (32, 40, 48, 64, 128)), "iban": lambda: sign(m[:2] in P.IBAN_COUNTRIES),
    }[kind]()
    context = -1 if any(h in before for h in P.COUNTER_HINTS) else int(any(h in before for h in P.HINTS[kind]))
    alone = not (before[-1:].isalnum() or after.isalnum())
    edges = sign(re.search(r"[=:]\s*[\"'`]?$", before)) if kind == "secret" else sign(alone)
    return (form, check, listed, context, edges), (int(strict), int(bool(re.search(r"[ ().-]", m))), int(len(m) > 20))


def brute_spans(texts):
    """All spans of some texts: plain matches, votes in plain Python, EM and classifier on their counts."""
    found, counts = [], {}
    for text in texts:
        own = []
        for kind in P.ALL_KINDS:
            for strict in (True, False) if kind in PLAIN else (False,):
                for m in re.finditer(PLAIN[kind] if strict else P.LOOSE[kind], text or ""):
                    ok = strict and passes(kind, m[0])
                    v, s = plain_votes(kind, strict, ok, m[0], text[max(0, m.start() - P.WINDOW) : m.start()].lower(), text[m.end() : m.end() + 1])
                    own.append((kind, m.start(), m.end(), ok, v, s))
                    counts[kind, v, s] = counts.get((kind, v, s), 0) + 1.0
        found.append(own)
    _, weights = P.learned(sorted((k, v, s, n) for (k, v, s), n in counts.items()))
    out = []
    touch = lambda a, b: a[1] < b[2] and b[1] < a[2]
    for own in found:
        base = [x for x in own if x[3]]
        score = lambda x: weights[x[0]][0] + sum(a * b for a, b in zip(weights[x[0]][1:], (*x[4], *x[5]), strict=True))
        more = [x for x in own if not x[3] and score(x) >= math.log(9) and not any(touch(x, b) for b in base)]
        more = [x for x in more if not any(touch(x, y) and x[0] == "secret" != y[0] for y in more)]
        out.append(",".join(f"{k}:{a}:{b}" for k, a, b, *_ in sorted(base + more, key=lambda x: (P.ALL_KINDS.index(x[0]), x[1], x[2]))))
    return out


def test_spans_of_the_query_equal_brute_force_and_add_to_the_base(spark):
    """All of a table: every span, and that the method finds what the base patterns do not."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in P.op6_pii(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute_spans([r.text for r in rows])
    assert all(got[r.doc_id].spans == w for r, w in zip(rows, want, strict=True))
    added = [r for r in got.values() if r.n_added]
    assert added and all(r.n_spans == len(r.spans.split(",")) for r in added)
    token = re.compile(r"""token = "([0-9a-f]{40})\"""")
    assert all(f"secret:{m.start(1)}:{m.end(1)}" in got[r.doc_id].spans.split(",") for r in rows for m in token.finditer(r.text or ""))


def test_added_kinds(spark):
    rows = [(i, f'api_key = "{hashlib.sha1(str(i).encode()).hexdigest()}" and commit {hashlib.sha1(str(-i).encode()).hexdigest()} {"word" * 30}', None, 1) for i in range(80)]
    iban = lambda i: f"DE{98 - int(f'{i:018d}131400') % 97:02d}{i:018d}"
    rows += [(500 + i, f"pay to account {iban(37040044053201300 + 7 * i)} please", None, 1) for i in range(40)] + [(900, "pay to DE89 3704 0044 0532 0130 00 or DE12 3704 0044 0532 0130 00", None, 1)]
    rows += [(1000 + i, f"Contact Joe{i} (AT) example (DOT) com or fe80::{i + 1}:2 the server", None, 1) for i in range(40)]
    got = {r.doc_id: r.spans for r in run(spark, rows)}
    assert all(got[i] == "secret:11:51" for i in range(80)) and all(got[500 + i] == "iban:15:37" for i in range(40)) and got[900] == "iban:7:34"
    assert all(got[1000 + i].startswith("email:8:") and "ip:" in got[1000 + i] for i in range(40))


@pytest.mark.parametrize("rows", [[], [(None, None, None, None)], [(1, "a@b.cc", "x", 2), (1, "a@b.cc", "x", 2)]])
def test_edge_cases(spark, rows):
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert all(r.spans == ("email:0:6" if r.doc_id else "") for r in got)


def test_query_digests_the_base_spans(spark, tmp_path):
    spark.createDataFrame([(1, "x a@b.cc 1.2.3.4")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = P.op6_pii(spark, str(tmp_path)).first()
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 0, 0)
    assert r.base_sha256 == hashlib.sha256(b"email:2:8,ip:9:16").hexdigest()


def test_long_texts_with_many_keys_and_addresses(spark):
    """Tens of thousands of spans in one text: time stays near linear, and spans are those of short texts side by side."""
    import time

    def key(i):
        letters = [chr(97 + int(c, 16)) for c in hashlib.sha256(str(i).encode()).hexdigest()]
        letters[3], letters[20], letters[40] = "7", "5", "3"
        return "".join(letters)

    part = lambda i: f"api_key={key(i)} from a{i}@site{i % 7}.com via 10.0.{i % 250}.7 and so on\n"
    n = 10_000
    small, large = "".join(part(i) for i in range(300)), "".join(part(i) for i in range(n))
    df = spark.createDataFrame([(1, small), (2, large)], "doc_id bigint, text string")
    began = time.perf_counter()
    rows = {r.doc_id: r for r in P.find_personal_data(df, Scratch(spark, "t")).select("doc_id", F.size("base").alias("b"), F.size("added").alias("a"), F.col("added.start").alias("s"), F.col("added.end").alias("e")).collect()}
    assert time.perf_counter() - began < 60
    assert rows[1].b == 600 and rows[2].b == 2 * n and rows[1].a == 300 and rows[2].a == n
    at = [large.index("=") + 1]
    for i in range(n - 1):
        at.append(at[-1] + len(part(i)))
    assert sorted(rows[2].s) == at and sorted(rows[2].e) == [x + 64 for x in at]


def test_keys_of_any_length(spark):
    long = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(40))
    rows = [(i, f"token={hashlib.sha256(str(i).encode()).hexdigest()[:40]} set") for i in range(60)] + [(100, f"api_key={long[:640]} set"), (101, f"api_key={long} set"), (102, "secret=" + "abcdefghijklmnopqrstuvwxyz" * 4 + "0123456789 set")]
    got = {r.doc_id: r.n for r in P.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string"), Scratch(spark, "t")).select("doc_id", F.size("added").alias("n")).collect()}
    assert got[100] == got[101] == got[102] == 1


def test_sweep_equals_all_pairs(spark):
    rng = random.Random(12)
    span = lambda: (lambda a: (a, a + rng.randint(1, 6)))(rng.randint(0, 600))
    rows = [(i, [span() for _ in range(rng.randint(0, 300))], [span() for _ in range(rng.choice([0, 1, 40, 300]))]) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, a array<struct<start:int,end:int>>, b array<struct<start:int,end:int>>")
    got = {r.i: [tuple(x) for x in r.u] for r in df.select("i", P.untouched(F.col("a"), F.col("b")).alias("u")).collect()}
    for i, a, b in rows:
        assert got[i] == [x for x in a if not any(x[0] < y[1] and y[0] < x[1] for y in b)]
