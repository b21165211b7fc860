"""Conversations whose turns were damaged, mended at least cost: a composition of weighted automata and its best path."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftcurve.llm.storage import Scratch
from driftcurve.session import with_code

SPACE = " \t\n\x0b\x0c\r"
#: What edits cost; a row that is cut short and stays adds CUT_SHORT.
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 1, 2, 5, 5
#: The role grammar (s?(ua)+)? as an acceptor: states, the next state by initial, the states that accept.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
ACCEPTING = (START, AFTER_A)
LEGAL_PAIRS = ("su", "ua", "au")
#: A piece of a conversation that one matrix of paths stands for.
SEGMENT_ROWS, SEGMENT_CHARS = 256, 1 << 20
#: Parts that the copies of one row fall into.
SALTS = 32


# --- automata -------------------------------------------------------------------------------------


def edits(initial: str, fault: str) -> Iterator[tuple[str, str, int]]:
    """The edit transducer's arcs for a row: (label, initial that it writes or none, cost)."""
    yield "D", "", DELETE
    if fault not in ("b", "d"):
        extra = CUT_SHORT if fault == "t" else 0
        yield "K", initial, KEEP + extra
        for written in "ua":
            yield "R", written, REROLE + extra


def insertions(state: int) -> Iterator[tuple[int, int, str]]:
    """(state, cost, labels) that inserting rows leads to. No state is met twice: each cycle costs more than nothing."""
    cost, labels, seen = 0, "", set()
    while state not in seen:
        yield state, cost, labels
        seen.add(state)
        cost, labels = cost + INSERT, labels + "I"
        # from each state one of the two initials goes on at most
        state = next((NEXT[state, x] for x in "ua" if (state, x) in NEXT), state)


@lru_cache(maxsize=64)
def row_arcs(initial: str, fault: str) -> list[tuple[int, int, int, str]]:
    """Composed arcs over one row, made when the row's kind is first met: (from, to, cost, labels), the best of each pair by (cost, labels).

    Insertions stand before the edit of a row, so all labels over the same rows end in an edit of the last one and none
    is the beginning of another: comparing (cost, labels) early or late comes to the same.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        for state, cost, labels in insertions(start):
            for label, written, price in edits(initial, fault):
                to = NEXT.get((state, written)) if written else state
                if to is not None:
                    weight = (cost + price, labels + label)
                    best[start, to] = min(weight, best.get((start, to), weight))
    return [(a, b, *w) for (a, b), w in best.items()]


@lru_cache(maxsize=4096)
def segment_paths(kinds: str) -> list[tuple[int, int, int, str]]:
    """As row_arcs over a run of rows, whose kinds are pairs of characters (initial, fault): best paths in the order of the rows."""
    out = []
    for start in range(4):
        best = {start: (0, "")}
        for i in range(0, len(kinds), 2):
            further: dict[int, tuple[int, str]] = {}
            for a, b, cost, labels in row_arcs(kinds[i], kinds[i + 1]):
                if a in best:
                    weight = (best[a][0] + cost, best[a][1] + labels)
                    if b not in further or weight < further[b]:
                        further[b] = weight
            best = further
        out += [(start, b, *w) for b, w in best.items()]
    return out


class Path:
    """The best paths from the start to each state, segment by segment. Labels are kept as linked parts, and their order as ranks."""

    def __init__(self):
        self.best = {START: (0, 0, None)}  # state: (cost, rank of the labels among the states', linked parts)

    def follow(self, arcs: list[tuple[int, int, int, str]]) -> None:
        further: dict[int, tuple] = {}
        for a, b, cost, labels in arcs:
            if a in self.best:
                done, rank, parts = self.best[a]
                weight = (done + cost, rank, labels)
                if b not in further or weight < further[b][0]:
                    further[b] = (weight, parts)
        order = {b: i for i, b in enumerate(sorted(further, key=lambda b: further[b][0][1:]))}
        self.best = {b: (w[0], order[b], (parts, w[2])) for b, (w, parts) in further.items()}

    def finish(self) -> tuple[int, str]:
        """Cost and labels of the best path to an accepting state, after insertions at the end."""
        ends = []
        for state, (cost, _, parts) in self.best.items():
            closing = [(c, labels) for to, c, labels in insertions(state) if to in ACCEPTING]
            if closing:
                price, labels = min(closing)
                ends.append((cost + price, parts, labels))
        least = min(c for c, *_ in ends)
        return least, min(joined(parts) + labels for c, parts, labels in ends if c == least)


def joined(parts) -> str:
    out = []
    while parts:
        parts, labels = parts
        out.append(labels)
    return "".join(reversed(out))


def replayed(labels: str, at: int, state: int, rows: list[tuple[str, str]], last: bool) -> Iterator[tuple[str, str, str, int, int]]:
    """(edit, role, text, next place in labels, next state) for each label on `rows` from place `at` on; labels behind the last row with `last` only."""
    waiting = iter(rows)
    left = len(rows)
    while at < len(labels) and (left or last):
        label = labels[at]
        role, text = ("", "") if label == "I" else next(waiting)
        left -= label != "I"
        if label in "IR":
            role = "assistant" if state == AFTER_U else "user"
        if label != "D":
            state = NEXT[state, role[:1]]
        at += 1
        yield label, role, text, at, state


# --- damage and faults ----------------------------------------------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone, seq) after damage by a hash of conversation and turn: a row is dropped (gone), emptied, loses its ends of sentences, comes twice, or is the user's."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))), F.lit(20))
    df = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), h.alias("h"), F.monotonically_increasing_id().alias("seq"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("h") > 0, F.col("text"))
    copies = F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    df = df.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("h") == 0).alias("gone"), "seq", copies.alias("copy"))
    return df.select("conv_id", "turn", "role", "text", "gone", (F.col("seq") * 2 + F.col("copy")).alias("seq"))


def as_they_are(rows: DataFrame) -> DataFrame:
    """Rows without damage in the form that `damaged` gives."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return rows.select("conv_id", "turn", shown("role"), shown("text"), F.lit(False).alias("gone"), F.monotonically_increasing_id().alias("seq"))


def place() -> Column:
    """A row's place in its conversation, as far as it matters for equal rows."""
    return F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn"), F.col("seq"))


def with_faults(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, print, seq, gone, role, text, kind): `kind` is the role's initial and the row's first fault, b(lank), d(uplicate) or t(runcated).

    A row is a duplicate if a row of its conversation before it has the same role and text. Equal rows are counted
    within SALTS parts first, and each part is joined by itself, so no key holds all copies of a row.
    """
    end = F.rtrim("text", F.lit(SPACE))
    shaped = rows.withColumns({"print": F.when(~F.col("gone"), F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), "blank": end == "", "cut": ~F.substring(end, -1, 1).isin(".", "!", "?")})
    shaped = scratch.table(shaped.withColumn("salt", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int")), "shaped")
    parts = shaped.where("NOT gone AND NOT blank").groupBy("conv_id", "print", "salt").agg(F.min(place()).alias("first"), F.count("*").alias("n"))
    keys = parts.groupBy("conv_id", "print").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    keys = keys.select(F.col("conv_id").alias("c"), F.col("print").alias("p"), "first", F.explode("salts").alias("s"))
    both = shaped.join(keys, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("print") == F.col("p")) & (F.col("salt") == F.col("s")), "left")
    fault = F.when(F.col("gone"), "-").when(F.col("blank"), "b").when(place() > F.col("first"), "d").when(F.col("cut"), "t").otherwise("-")
    initial = F.substring("role", 1, 1)
    kind = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("?"), fault)
    faulty = both.select("conv_id", "turn", "print", "seq", "gone", "role", "text", kind.alias("kind"))
    return scratch.table(faulty.withColumn("text", F.when(~F.substring("kind", 2, 1).isin("b", "d"), F.col("text"))), "faults")


# --- in tasks -------------------------------------------------------------------------------------

PIECE = "conv_id bigint, kind int, part bigint, kinds string, n_turns bigint, low bigint, high bigint, first string, last string, illegal bigint, roles array<string>, texts array<string>"


def as_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to segments: of each a row without texts (kind 0) and one with them (kind 1). `part` numbers the segments in order."""
    part = TaskContext.get().partitionId() << 32
    names = [f.split()[0] for f in PIECE.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(f.split()[0], types[f.split()[1]]) for f in PIECE.split(", ")])
    rows: list[tuple] = []
    done: list[tuple] = []
    size, held, conv = 0, 0, object()

    def closed() -> None:
        nonlocal rows, size, part, held
        if not rows:
            return
        there = [r for r in rows if not r[2]]
        turns = [r[1] for r in there if r[1] is not None]
        initials = [r[3][:1] for r in there]
        illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:], strict=False))
        kinds, edge = "".join(r[5] for r in there), (initials[0], initials[-1]) if there else (None, None)
        n_turns = len(set(turns))
        low, high = (turns[0], turns[-1]) if turns else (None, None)
        done.append((rows[0][0], 0, part, kinds, n_turns, low, high, *edge, illegal, None, None))
        if there:
            done.append((rows[0][0], 1, part, None, None, None, None, None, None, None, [r[3] for r in there], [r[4] for r in there]))
        part, held = part + 1, held + size
        rows, size = [], 0

    def out() -> pa.RecordBatch:
        nonlocal done, held
        batch = pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, zip(*done, strict=True), strict=True)], schema=schema)
        done, held = [], 0
        return batch

    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if r[0] != conv or len(rows) == SEGMENT_ROWS or size > SEGMENT_CHARS:
                closed()
                conv = r[0]
            rows.append(r)
            size += len(r[4] or "") + len(r[3])
            if held > SEGMENT_CHARS or len(done) > 4096:
                yield out()
    closed()
    if done:
        yield out()


REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
TURNS = "conv_id bigint, place bigint, edit string, role string, text string"
LONGEST = (1 << 63) - 1


class Conversation:
    """One conversation's segments in order: first all their kinds, then all their texts."""

    def __init__(self, conv: int | None):
        self.conv, self.path, self.labels = conv, Path(), None
        self.counts = {"b": 0, "d": 0, "t": 0}
        self.illegal, self.turns, self.low, self.high, self.last = 0, 0, None, None, None
        self.state, self.at, self.lines, self.hash = START, 0, 0, hashlib.sha256()

    def shape(self, r: dict) -> None:
        """A segment without its texts."""
        if not r["kinds"]:
            return
        self.path.follow(segment_paths(r["kinds"]))
        for f in self.counts:
            self.counts[f] += r["kinds"][1::2].count(f)
        self.illegal += r["illegal"] + (self.last is not None and self.last + r["first"] not in LEGAL_PAIRS)
        self.last = r["last"]
        if r["n_turns"]:
            self.turns += r["n_turns"] - (self.high is not None and self.high == r["low"])
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]

    def solve(self) -> None:
        if self.labels is None:
            self.cost, self.labels = self.path.finish()

    def mend(self, rows: list[tuple[str, str]], last: bool) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the next rows."""
        for edit, role, text, self.at, self.state in replayed(self.labels, self.at, self.state, rows, last):
            yield edit, role, text

    def digest(self, rows: list[tuple[str, str]], last: bool = False) -> None:
        for edit, role, text in self.mend(rows, last):
            if edit != "D":
                self.hash.update(("\n" if self.lines else "").encode() + f"{role}:{text or ''}".encode())
                self.lines += 1

    def report(self) -> tuple:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, LONGEST)
        return self.conv, gaps, self.counts["b"], self.counts["d"], self.counts["t"], self.illegal, self.cost, self.labels, self.hash.hexdigest()


def conversations(batches: Iterator[pa.RecordBatch], on_rows, on_end) -> Iterator:
    """Walk sorted segments; `on_rows` sees each segment's texts, `on_end` each conversation, and both may give rows."""
    now: Conversation | None = None
    for b in batches:
        for i in range(b.num_rows):
            r = {n: b.column(k)[i].as_py() for k, n in enumerate(b.schema.names)}
            if now is None or r["conv_id"] != now.conv:
                if now is not None:
                    now.solve()
                    yield from on_end(now)
                now = Conversation(r["conv_id"])
            if r["kind"] == 0:
                now.shape(r)
            else:
                now.solve()
                yield from on_rows(now, list(zip(r["roles"], r["texts"], strict=True)))
    if now is not None:
        now.solve()
        yield from on_end(now)


def batched(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most 4096 rows or some SEGMENT_CHARS letters."""
    fields = [f.split() for f in schema.split(", ")]
    own = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in fields])
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, own.field(i).type) for i, c in enumerate(zip(*held, strict=True))], schema=own)
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) == 4096 or size > SEGMENT_CHARS:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def as_reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def on_rows(c, rows):
        c.digest(rows)
        return ()

    def on_end(c):
        c.digest([], True)
        return (c.report(),)

    return batched(conversations(batches, on_rows, on_end), REPORT)


def as_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def some(c, rows, last=False):
        for edit, role, text in c.mend(rows, last):
            if edit != "D":
                c.lines += 1
                yield c.conv, c.lines, edit, role, text or ""

    return batched(conversations(batches, some, lambda c: some(c, [], True)), TURNS)


# --- on tables ------------------------------------------------------------------------------------


def segments(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """All segments, those of a conversation together and in order.

    Rows are cut by ranges of (conversation, turn, digest, number), so a conversation of any length, even one whose turns
    are all alike, lies over as many tasks as it fills. A segment stands for its rows by the best paths between the
    grammar's four states, and only segments meet at the end.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("print").asc_nulls_first(), F.col("seq")]
    faults = with_faults(rows, scratch)
    n = int(faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = faults.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "gone", "role", "text", "kind")
    pieces = with_code(dealt).mapInArrow(as_pieces, PIECE)
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part")


def repair_reports(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per conversation of `rows` (see `damaged`): its faults, the cheapest edits and the digest of what they give.

    Each conversation's rows (input acceptor), the edits (transducer) and the grammar of roles (acceptor) are composed as
    far as paths reach; the best path has the least (cost, labels). Rows of one turn come in the order of a digest of
    role and text, equal rows behind each other.

    Defined cases: null ids, turns, roles and texts count as one space, where they are shown or compared; null turns come
    first and have no gaps; null ids are one conversation; a conversation without rows has zeros, no edits and the digest
    of the empty string; an empty table gives an empty result; other columns are ignored, whatever their names. Gaps beyond
    a long are held at its end.
    """
    return with_code(segments(rows, scratch)).mapInArrow(as_reports, REPORT)


def repaired_turns(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, place, edit, role, text): the mended conversations of `rows`, cases as in repair_reports. A conversation with nothing left has no row."""
    return with_code(segments(rows, scratch)).mapInArrow(as_turns, TURNS)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `conversations`, damaged and mended."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_reports(damaged(rows), Scratch(spark, "repair"))


#: The same by a recursive query over rows; the check sum comes from a table of bytes.
OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)
  )
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ord(x) AS BIGINT))),
                         lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS h
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE h > 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text), copy) AS pos, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged
), rows AS (
  SELECT conv_id, turn, pos, role, text, substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before,
         CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault
  FROM placed
), follows(g, x, g2) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), inserted(g, h, cost, label) AS (
  VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')
), edits AS (
  SELECT conv_id, pos, h AS g, h AS g2, 2 AS cost, 'D' AS label FROM rows, (VALUES (0), (1), (2), (3)) s(h)
  UNION ALL SELECT conv_id, pos, g, g2, CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'K' FROM rows JOIN follows ON x = initial WHERE fault IN ('-', 't')
  UNION ALL SELECT conv_id, pos, g, g2, CASE WHEN fault = 't' THEN 6 ELSE 1 END, 'R' FROM rows JOIN follows ON x IN ('u', 'a') WHERE fault IN ('-', 't')
), arcs AS (
  SELECT conv_id, pos, i.g, g2, min(i.cost + e.cost) AS cost, arg_min(i.label || e.label, (i.cost + e.cost, i.label || e.label)) AS label FROM edits e JOIN inserted i ON i.h = e.g GROUP BY ALL
), sizes AS (
  SELECT c.conv_id, coalesce(max(pos), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rows r ON c.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY c.conv_id
), paths AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS pos, 0 AS g, CAST(0 AS BIGINT) AS cost, CAST('' AS VARCHAR) AS label FROM sizes
  UNION ALL
  SELECT p.conv_id, p.pos + 1, a.g2, CAST(min(p.cost + a.cost) AS BIGINT), arg_min(p.label || a.label, (p.cost + a.cost, p.label || a.label))
  FROM paths p JOIN arcs a ON a.conv_id IS NOT DISTINCT FROM p.conv_id AND a.pos = p.pos + 1 AND a.g = p.g GROUP BY p.conv_id, p.pos, a.g2
), best AS (
  SELECT p.conv_id, min(p.cost + i.cost) AS cost, arg_min(p.label || i.label, (p.cost + i.cost, p.label || i.label)) AS audit
  FROM paths p JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.n = p.pos JOIN inserted i ON i.g = p.g AND i.h IN (0, 3) GROUP BY p.conv_id
), steps AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS label, unnest(range(1, length(audit) + 1)) AS k FROM best WHERE audit <> ''
), met AS (
  SELECT *, count(*) FILTER (label <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS pos FROM steps
), kept AS (
  SELECT m.conv_id, m.k, m.label, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.k) AS nth, r.role, r.text, r.initial
  FROM met m LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.pos = m.pos AND m.label <> 'I' WHERE m.label <> 'D'
), led AS (
  SELECT *, CAST(first_value(label = 'K' AND initial = 's') OVER (PARTITION BY conv_id ORDER BY k) AS INTEGER) AS lead FROM kept
), mended AS (
  SELECT conv_id, string_agg(CASE WHEN label = 'K' THEN role WHEN (nth - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS whole FROM led GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
         count(*) FILTER (pos > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
)
SELECT s.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(b.cost AS BIGINT) AS cost, audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM sizes s JOIN best b ON b.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN mended m ON m.conv_id IS NOT DISTINCT FROM s.conv_id
"""
