"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftcurve.llm.storage import Scratch

KINDS = ("email", "ip", "card", "phone")
#: What the method finds beside the base kinds: keys and passwords, account numbers.
ALL_KINDS = (*KINDS, "secret", "iban")

# Possessive quantifiers and run starts keep these linear on long runs; what they match, leftmost and
# non-overlapping, is what the plain patterns match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser forms, candidates only: spelt-out addresses, IPv6, other separators, numbers without a plus; long runs that hold a
#: digit; account numbers.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\s?(?i:\(at\)|\[at\]|\{at\}|(?<=\s)at(?=\s))\s?[A-Za-z0-9-]++(?:\s?(?i:\(dot\)|\[dot\]|\{dot\}|(?<=\s)dot(?=\s))\s?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}

# Gazetteers and context words.
TLDS = ("com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "nl", "uk", "us", "ca", "ch", "at", "be", "pl", "pt", "br", "mx", "jp", "cn", "in", "au")
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36")
UNROUTABLE = ("0.", "127.", "255.", "224.", "239.")
IBAN_COUNTRIES = ("AD", "AE", "AT", "BE", "BG", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IL", "IS", "IT", "LI", "LT", "LU", "LV", "MC", "MT", "NL", "NO", "PL", "PT", "RO", "RS", "SA", "SE", "SI", "SK", "SM", "TR", "UA")
#: How well-known services' keys start, and how long hexadecimal keys are.
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "ya29", "eyJ", "npm_", "hf_")
HEX_KEY = "^(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{64}|[0-9a-f]{128})$"
HINTS = {
    "email": ("mail", "contact", "write to", "kontakt", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "login", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "whatsapp", "telefon", "llam"),
    "secret": ("token", "secret", "passw", "api key", "api_key", "api-key", "apikey", "access key", "access_key", "private key", "auth", "bearer", "credential", "pwd"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
}
COUNTER_HINTS = ("version", "isbn", "issn", "invoice", "order no", "chapter", "section", "release", "serial", "part no", "doi", "sku", "checksum", "sha1", "sha256", "md5", "commit", "etag")
LABELERS = ("form", "check", "gazetteer", "context", "edges")
SHAPES = 3
WINDOW = 40
CHUNK = 256
ACCEPT = 0.9


# --- spans --------------------------------------------------------------------------------------


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is evaluated once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scanned(items: Column, zero: Column, step: Callable, emit: Callable, kind: str) -> Column:
    """emit(state, item) for each item of an array, the state being what `step` made of the items before it.

    The state is carried over chunks first and then within each, so that an array of n items costs n steps twice
    and no output is copied more often than a chunk has items.
    """

    def over(own: Column) -> Column:
        chunk = lambda c: F.slice(own, c * CHUNK + 1, F.lit(CHUNK))
        numbers = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / CHUNK).cast("int"))
        starts = F.aggregate(numbers, F.array(zero), lambda a, c: F.concat(a, F.array(F.aggregate(chunk(c), F.element_at(a, -1), step))))
        none = F.array().cast(f"array<{kind}>")
        within = lambda start, c: F.aggregate(chunk(c), F.struct(start.alias("s"), none.alias("out")), lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], F.array(emit(a["s"], x))).alias("out")), lambda a: a["out"])
        return let(starts, lambda st: F.flatten(F.transform(numbers, lambda c: within(F.element_at(st, c + 1), c))))

    return let(items, lambda own: F.when(F.size(own) > 0, over(own)).otherwise(F.array().cast(f"array<{kind}>")))


SPAN = "struct<start:int,end:int,value:string,before:string,after:string>"


def located(matches: Column, gaps: Column) -> Column:
    """Matches and the gaps between them as structs (start, end, value, before, after): places in code points, WINDOW characters before the match and one behind it."""
    n = F.size(matches)
    items = F.arrays_zip(F.slice(gaps, 1, n).alias("gap"), matches.alias("value"), F.slice(gaps, 2, n).alias("next"), F.concat(F.slice(matches, 2, n), F.array(F.lit(""))).alias("follows"))
    last = lambda *parts: F.right(F.concat(*(F.right(p, F.lit(WINDOW)) for p in parts)), F.lit(WINDOW))
    width = lambda x: F.length(x["gap"]) + F.length(x["value"])
    step = lambda s, x: F.struct((s["at"] + width(x)).alias("at"), last(s["tail"], x["gap"], x["value"]).alias("tail"))

    def emit(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        behind = F.when(x["next"] != "", F.left(x["next"], F.lit(1))).otherwise(F.left(x["follows"], F.lit(1)))
        return F.struct(start.alias("start"), (s["at"] + width(x)).alias("end"), x["value"].alias("value"), F.lower(last(s["tail"], x["gap"])).alias("before"), behind.alias("after"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
    return F.when(n > 0, scanned(items, zero, step, emit, SPAN)).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_matches(df: DataFrame, text: str, name: str, pattern: str, guard: Column) -> DataFrame:
    """Add column `name`: the spans of `pattern` in a text; `guard` is a cheap test that a match needs."""
    found = F.when(guard, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("__m", found)
    df = df.withColumn("__g", F.when(F.size("__m") > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")))
    return df.withColumn(name, located(F.col("__m"), F.col("__g"))).drop("__m", "__g")


def luhn(digits: Column) -> Column:
    def part(d: Column, i: Column) -> Column:
        n = d.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """What a match of the base pattern must also meet."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= F.lit("255"))))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


def guards(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    return {
        "email": text.contains("@"), "ip": digit & text.contains("."), "card": digit, "phone": text.contains("+"),
        "loose_email": text.rlike(r"(?i)[(\[{\s]dot[)\]}\s]"), "loose_ip": text.contains(":"), "loose_card": digit & text.rlike("[0-9][./_][0-9]"), "loose_phone": text.rlike("[0-9]{3}[ .-][0-9]{4}"),
        "loose_secret": digit & text.rlike("[A-Za-z0-9+/_-]{20}"), "loose_iban": text.rlike("[A-Z]{2}[0-9]{2}"),
    }


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, found): every match in each whole text, failed ones and loose forms included, with the labelers' votes and its shape."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    for name, guard in guards(F.col("__t")).items():
        kind = name.removeprefix("loose_")
        df = with_matches(df, "__t", f"__{name}", LOOSE[kind] if name != kind else BASE[kind], guard)

    def described(name: str) -> Column:
        kind = name.removeprefix("loose_")

        def one(x: Column) -> Column:
            ok = passes(kind, x["value"]) if name == kind else F.lit(False)
            return F.struct(F.lit(kind).alias("kind"), F.lit(name == kind).alias("strict"), ok.alias("ok"), *(x[c].alias(c) for c in ("start", "end", "value", "before", "after")))

        return F.transform(F.col(f"__{name}"), one)

    df = df.withColumn("seen", F.concat(*(described(name) for name in guards(F.lit("")))))
    keep = lambda x: F.struct(x["kind"], x["strict"], x["ok"], x["start"], x["end"], F.array(*votes(x)).alias("votes"), F.array(*shape(x)).alias("shape"))
    return df.select("doc_id", F.transform("seen", keep).alias("found"))


# --- labelers -----------------------------------------------------------------------------------


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def votes(x: Column) -> list[Column]:
    """The labelers' votes on a candidate, in LABELERS' order: 1 for, -1 against, 0 no opinion."""
    value = F.lower(x["value"])
    digits = F.regexp_replace(value, "[^0-9]", "")
    by_kind = lambda cases: reduce(lambda c, k: c.when(x["kind"] == k, cases[k]), ALL_KINDS[1:], F.when(x["kind"] == ALL_KINDS[0], cases[ALL_KINDS[0]]))
    sign = lambda c: F.when(c, 1).otherwise(-1)
    starts = lambda text, all_of: reduce(lambda a, b: a | b, (text.startswith(p) for p in all_of))
    sorts = [F.when(x["value"].rlike(p), 1).otherwise(0) for p in ("[a-z]", "[A-Z]", "[0-9].*[0-9].*[0-9]")]
    form = F.when(x["kind"] == "secret", sign((sorts[0] + sorts[1] > 0) & (sorts[2] > 0))).when(x["strict"], sign(x["ok"])).otherwise(0)
    plausible = by_kind({
        "email": sign(F.length(value).between(6, 254)),
        "ip": F.when(x["strict"], sign(x["ok"])).otherwise(sign(value.rlike("[0-9]") & (F.size(F.split(value, ":+")) <= 8))),
        "card": F.when(F.length(digits).between(13, 19), sign(F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False))).otherwise(-1),
        "phone": sign(F.length(digits).between(9, 15) | (F.length(digits) == 10)),
        "secret": sign(F.size(F.array_distinct(F.split(x["value"], ""))) >= 10),
        "iban": sign(remainder_97(x["value"]) == 1),
    })
    listed = by_kind({
        "email": sign(F.regexp_extract(value, "([a-z]+)$", 1).isin(*TLDS)),
        "ip": sign(~starts(value, UNROUTABLE)),
        "card": sign(starts(digits, ISSUERS)),
        "phone": sign(~digits.startswith("0") & ~digits.rlike("^([0-9])\\1+$")),
        "secret": F.when(starts(x["value"], KEY_STARTS) | x["value"].rlike(HEX_KEY), 1).otherwise(0),
        "iban": sign(F.substring(x["value"], 1, 2).isin(*IBAN_COUNTRIES)),
    })
    hinted = by_kind({k: any_of(x["before"], HINTS[k]) for k in ALL_KINDS})
    context = F.when(any_of(x["before"], COUNTER_HINTS), -1).when(hinted, 1).otherwise(0)
    left = F.when(F.length(x["before"]) == 0, " ").otherwise(F.right(x["before"], F.lit(1)))
    loose_edge = left.rlike(r"[\p{L}\p{N}]") | x["after"].rlike(r"[\p{L}\p{N}]")
    assigned = x["before"].rlike(r"[=:]\s*[\"'`]?$")
    return [form, plausible, listed, context, F.when(x["kind"] == "secret", sign(assigned)).otherwise(sign(~loose_edge))]


def remainder_97(value: Column) -> Column:
    """An account number's remainder: its first four characters go to the end, letters count from ten, the whole is taken mod 97."""
    bare = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    one = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise((a * F.when(one(c) > 9, 100).otherwise(10) + one(c)) % 97))


def shape(x: Column) -> list[Column]:
    """Binary features of a candidate beside the votes: for the classifier."""
    flag = lambda c: F.when(c, 1).otherwise(0)
    return [flag(x["strict"]), flag(x["value"].rlike(r"[\x20().-]")), flag(x["end"] - x["start"] > 20)]


# --- aggregation of votes -----------------------------------------------------------------------


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


@dataclass
class Trust:
    """What EM finds of a kind: the share of true spans among candidates of the base form and of others, and how often each labeler says yes to a true and to a false span."""

    prior: dict[bool, float]
    yes_if_true: list[float]
    yes_if_false: list[float]

    def posterior(self, votes: tuple[int, ...], strict: bool) -> float:
        odds = math.log(self.prior[strict] / (1 - self.prior[strict]))
        for v, t, f in zip(votes, self.yes_if_true, self.yes_if_false, strict=True):
            odds += math.log(t / f) if v > 0 else math.log((1 - t) / (1 - f)) if v < 0 else 0.0
        return sigmoid(odds)


def reliabilities(patterns: list[tuple[tuple[int, ...], bool, float]], rounds: int = 50) -> tuple[Trust, list[float]]:
    """EM over vote patterns (votes, whether of the base form) and their counts: the labelers' reliabilities and each pattern's posterior.

    A labeler has two rates, so one that says yes to everything tells nothing, and one that the others
    contradict counts against what it says; no opinion tells nothing. Rates are smoothed as if ten more true and ten
    more false spans had been seen, of which it said yes to eight and to five, and shares as if five in ten were true:
    what a rare kind stays near.
    """
    post = [sigmoid(sum(v)) for v, _, _ in patterns]
    trust = Trust({}, [], [])
    for _ in range(rounds):
        for strict in (True, False):
            own = [(p, n) for p, (_, s, n) in zip(post, patterns, strict=True) if s == strict]
            share = (sum(p * n for p, n in own) + 5) / (sum(n for _, n in own) + 10)
            trust.prior[strict] = min(0.995, max(0.005, share))
        rates = []
        for i in range(len(LABELERS)):
            own = [(p, v[i], n) for p, (v, _, n) in zip(post, patterns, strict=True) if v[i]]
            true, false = sum(p * n for p, _, n in own), sum((1 - p) * n for p, _, n in own)
            rates.append(((sum(p * n for p, v, n in own if v > 0) + 8) / (true + 10), (sum((1 - p) * n for p, v, n in own if v > 0) + 5) / (false + 10)))
        trust.yes_if_true, trust.yes_if_false = (list(x) for x in zip(*rates, strict=True))
        post = [trust.posterior(v, s) for v, s, _ in patterns]
    return trust, post


def train(rows: list[tuple[list[int], float, float]], rounds: int = 25, ridge: float = 0.1) -> list[float]:
    """Logistic regression (bias first) on feature patterns, their soft labels and counts, by Newton's steps; the ridge spares the bias."""
    if not rows:
        return [0.0] * (1 + len(LABELERS) + SHAPES)
    x = np.array([[1, *r[0]] for r in rows], float)
    y, n = np.array([r[1] for r in rows]), np.array([r[2] for r in rows], float)
    w = np.zeros(x.shape[1])
    held = np.full(len(w), ridge)
    held[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (n * (y - p)) - held * w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    return w.tolist()


def fit(found: DataFrame) -> tuple[dict[str, Trust], dict[str, list[float]]]:
    """Reliabilities and the span classifier's weights by kind, from counts of vote and feature patterns.

    The counts are aggregated on the cluster; what reaches the driver has at most
    6 kinds x 3^5 votes x 2^3 shapes rows, however many documents there are.
    """
    seen = found.select(F.explode("found").alias("x")).select("x.kind", "x.votes", "x.shape")
    rows = sorted((r["kind"], tuple(r["votes"]), tuple(r["shape"]), float(r["n"])) for r in seen.groupBy("kind", "votes", "shape").agg(F.count("*").alias("n")).collect())
    return learned(rows)


def learned(rows: list[tuple[str, tuple[int, ...], tuple[int, ...], float]]) -> tuple[dict[str, Trust], dict[str, list[float]]]:
    """As fit, from the counted patterns (kind, votes, shape, count)."""
    trust, weights = {}, {}
    for kind in ALL_KINDS:
        own = [(v, s, n) for k, v, s, n in rows if k == kind]
        if own:
            trust[kind], post = reliabilities([(v, bool(s[0]), n) for v, s, n in own])
            weights[kind] = train([([*v, *s], p, n) for (v, s, n), p in zip(own, post, strict=True)])
    return trust, weights


def untouched(spans: Column, by: Column) -> Column:
    """Those of some spans that overlap none of `by`, from one sweep over starts of `by` and ends of `spans`: a span is touched if of what starts before its end something ends behind its start."""
    event = lambda pos, at, far, i: F.struct(pos.alias("pos"), F.lit(at).alias("by"), far.alias("far"), i.alias("i"))

    def sweep(own: Column) -> Column:
        events = F.concat(F.transform(by, lambda b: event(b["start"], 1, b["end"], F.lit(-1))), F.transform(own, lambda x, i: event(x["end"], 0, x["start"], i)))
        step = lambda s, e: F.when(e["by"] == 1, F.greatest(s, e["far"])).otherwise(s)
        touched = scanned(F.sort_array(events), F.lit(-1), step, lambda s, e: F.when((e["by"] == 0) & (s > e["far"]), e["i"]).otherwise(F.lit(-1)), "int")
        places = F.transform(own, lambda _, i: i)
        return F.transform(F.array_except(places, touched), lambda i: F.get(own, i))

    return let(spans, lambda own: F.when((F.size(own) > 0) & (F.size(by) > 0), sweep(own)).otherwise(own))


def decided(found: DataFrame, weights: dict[str, list[float]], accept: float = ACCEPT) -> DataFrame:
    """(doc_id, base, added): base spans, and the further candidates that the classifier accepts and that touch no base span and no better candidate.

    Of added spans that touch one another those with a form of their own (address, number) go before keys.
    """
    df = found.withColumn("base", F.filter("found", lambda x: x["strict"] & x["ok"]))
    none = [-1e9] + [0.0] * (len(LABELERS) + SHAPES)
    table = F.create_map(*(c for k in ALL_KINDS for c in (F.lit(k), F.array(*(F.lit(float(w)) for w in weights.get(k, none))))))

    def score(x: Column) -> Column:
        w = table[x["kind"]]
        terms = F.zip_with(F.slice(w, 2, len(none)), F.concat(x["votes"], x["shape"]), lambda a, b: a * b)
        return F.aggregate(terms, w[0], lambda a, t: a + t)

    bar = math.log(accept / (1 - accept))
    likely = F.filter("found", lambda x: ~(x["strict"] & x["ok"]) & (score(x) >= F.lit(bar)))
    df = df.withColumn("more", untouched(likely, F.col("base")))
    df = df.withColumns({"others": F.filter("more", lambda x: x["kind"] != "secret"), "keys": F.filter("more", lambda x: x["kind"] == "secret")})
    return df.withColumn("added", F.concat("others", untouched(F.col("keys"), F.col("others")))).select("doc_id", "base", "added")


def find_personal_data(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, base, added): the spans (kind, start, end, value ...) of personal data in each whole text.

    Base spans are those of the four base patterns that pass their checks and always stay. Five
    labelers (form, check, gazetteer, context, edges) vote on every match, failed ones, looser
    forms, keys and account numbers included; EM estimates their reliabilities, kind by kind, from the counts of
    vote patterns, and the posteriors train the logistic span classifier, which alone decides on further spans.

    Defined cases: a null text counts as empty and has no spans; rows that repeat a doc_id each come
    back; a null doc_id stays null; an empty table gives an empty one; other columns are ignored.
    Positions are code points from 0, ends exclusive.
    """
    found = scratch.table(find_spans(docs), "found")
    _, weights = fit(found)
    return decided(found, weights)


def listing(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start, comma-joined."""
    rank = lambda x: reduce(lambda c, i: c.when(x["kind"] == ALL_KINDS[i], i), range(1, len(ALL_KINDS)), F.when(x["kind"] == ALL_KINDS[0], 0))
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(rank(x).alias("k"), x["start"].alias("s"), x["end"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all of `documents`: counts and digest of the base spans, all spans, and counts with the added ones.

    `n_secret` and `n_iban` count the kinds that only the method finds, `n_added` all that it adds and `n_spans` all spans.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal_data(docs, Scratch(spark, "pii"))
    of_kind = lambda spans, k: F.size(F.filter(spans, lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    counts = [of_kind("base", k) for k in KINDS] + [of_kind("added", k) for k in ALL_KINDS[len(KINDS) :]]
    sums = [F.size("added").cast("bigint").alias("n_added"), (F.size("base") + F.size("added")).cast("bigint").alias("n_spans")]
    return found.select("doc_id", *counts, *sums, F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"), listing(F.concat("base", "added")).alias("spans"))
