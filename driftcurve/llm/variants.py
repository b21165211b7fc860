"""Spelling variants: words of a corpus that differ by one letter, found by two-dimensional range reporting over wavelet trees."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftcurve.llm.storage import Scratch
from driftcurve.session import with_code

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form must be this many times as frequent as the word that it stands for.
TIMES = 5
#: A run whose hash this divides loses a letter.
MODULUS = 199
RUN = "[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH
#: Letters of a group above which its range of edit positions is halved, and letters of one wavelet tree's words.
GROUP_CHARS, TREE_CHARS = 1 << 18, 1 << 19
#: Rectangles that are reported at a time.
RECTANGLES = 1 << 16


# --- words ----------------------------------------------------------------------------------------


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of LEAST_LENGTH letters or more and how often each occurs, in built-in functions alone."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run"))
    k = F.pmod(h, F.length("run").cast("bigint")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), k), F.substring("run", k + 2, F.length("run")))
    words = runs.select(F.when(F.pmod(h, F.lit(MODULUS)) == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


# --- words that can be near each other ------------------------------------------------------------


def grouped(words: DataFrame) -> DataFrame:
    """Entries (size, lo, hi, word, n) of the words: for each the two halves of the positions at which a word of `size` letters is edited.

    An edit replaces the letter at a position or inserts one before it. A word is entered as one that is edited, and as
    the longer result of an insertion into one that is a letter shorter.
    """
    half = lambda size: F.floor((size + 1) / 2).cast("int")
    length = F.length("word")
    own = words.withColumn("size", F.explode(F.filter(F.array(length, length - 1), lambda x: x >= LEAST_LENGTH)))
    size = F.col("size")
    holes = F.array(F.struct(F.lit(0).alias("lo"), half(size).alias("hi")), F.struct(half(size).alias("lo"), (size + 1).alias("hi")))
    return own.select("size", F.inline(holes), "word", "n")


def keyed(entries: DataFrame) -> DataFrame:
    """Add `key`: the letters before the positions [lo, hi) and those behind them, which words that differ there by one edit share."""
    behind = F.greatest(F.col("size") - F.col("hi"), F.lit(0))
    return entries.withColumn("key", F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit("|"), F.when(behind > 0, F.substring("word", F.length("word") - behind + 1, behind)).otherwise("")))


GROUP = ("size", "lo", "hi", "key")


def bounded_groups(words: DataFrame, scratch: Scratch, most: int = GROUP_CHARS) -> DataFrame:
    """Entries in groups of at most `most` letters, so that near words share one group for each position of the edit.

    A larger group's positions are halved, again and again: its words then share more letters. Where one position is
    left, a group holds all words that differ there, which the alphabet bounds.
    """
    entries, done, level = scratch.table(keyed(grouped(words)), "entries-0"), [], 0
    while True:
        large = entries.where("hi - lo > 1").groupBy(*GROUP).agg(F.sum(F.length("word")).alias("chars")).where(F.col("chars") > most).select(*(F.col(c).alias(f"_{c}") for c in GROUP))
        large = scratch.table(large, f"large-{level}")
        if large.isEmpty():
            break
        same = [F.col(c) == F.col(f"_{c}") for c in GROUP]
        done.append(entries.join(large, same, "left_anti"))
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
        level += 1
        entries = scratch.table(keyed(entries.join(large, same, "left_semi").select("size", "word", "n", F.inline(halves))), f"entries-{level}")
    for part in done:
        entries = entries.unionByName(part)
    return entries


# --- in tasks -------------------------------------------------------------------------------------


class WaveletTree:
    """A permutation, kept bit by bit from the highest: each level holds how many zeros lie before each place; zeros go first to the next."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.before: list[np.ndarray] = []
        for b in range(self.bits - 1, -1, -1):
            zero = (values >> b) & 1 == 0
            self.before.append(np.r_[0, np.cumsum(zero)])
            values = np.concatenate([values[zero], values[~zero]])

    def report(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) for each value in [y0, y1) at a place in [x0, x1), all rectangles at once."""
        own = np.flatnonzero((x0 < x1) & (y0 < y1))
        lo, hi, v = x0[own], x1[own], np.zeros(len(own), np.int64)
        for level, before in enumerate(self.before):
            rest = self.bits - 1 - level
            left = before[lo], before[hi]
            zeros = before[-1]
            own, lo, hi = np.r_[own, own], np.r_[left[0], zeros + lo - left[0]], np.r_[left[1], zeros + hi - left[1]]
            v = np.r_[v << 1, (v << 1) | 1]
            live = (lo < hi) & (v << rest < y1[own]) & ((v + 1) << rest > y0[own])
            own, lo, hi, v = own[live], lo[live], hi[live], v[live]
        return own, v


@dataclass
class Order:
    """Words of two lengths in one sorted order: each word's rank, and how many letters it shares with its neighbour before it."""

    rank: np.ndarray
    at: np.ndarray
    shared: np.ndarray

    @staticmethod
    def of(letters: np.ndarray) -> Order:
        width = letters.shape[1]
        at = np.argsort(np.ascontiguousarray(letters).view(f"S{width}")[:, 0], kind="stable")
        rank = np.empty(len(at), np.int64)
        rank[at] = np.arange(len(at))
        differ = letters[at[1:]] != letters[at[:-1]]
        return Order(rank, at, np.r_[-1, np.where(differ.any(axis=1), differ.argmax(axis=1), width)])

    def interval(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """By rank, the range of ranks whose words start with the same k letters."""
        first = self.shared < k
        if k == 0:
            return np.zeros(len(first), np.int64), np.full(len(first), len(first))
        starts = np.flatnonzero(first)
        group = np.cumsum(first) - 1
        return starts[group], np.r_[starts[1:], len(first)][group]


@dataclass
class Points:
    """Those of an order's words that have one length, as points (forward rank, backward rank) under a wavelet tree."""

    members: np.ndarray
    upto: tuple[np.ndarray, np.ndarray]
    by_second: np.ndarray
    tree: WaveletTree

    @staticmethod
    def of(chosen: np.ndarray, forward: Order, backward: Order) -> Points:
        members = forward.at[chosen[forward.at]]
        by_second = backward.at[chosen[backward.at]]
        second = np.empty(len(chosen), np.int64)
        second[by_second] = np.arange(len(by_second))
        upto = tuple(np.r_[0, np.cumsum(chosen[o.at])] for o in (forward, backward))
        return Points(members, upto, by_second, WaveletTree(second[members]))


def padded(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def near_pairs(words: list[bytes], size: int, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, near word) as places in `words`, each pair once in either order: one is `size` letters long and is edited at a position in [lo, hi).

    For each position the words that start like the edited one lie in an interval of the forward order, those that end
    like it in one of the backward order; the tree reports what lies in both.
    """
    length = np.array([len(w) for w in words])
    short = length == size
    if not short.any() or len(words) < 2:
        return
    width = size + 1
    forward, backward = Order.of(padded(words, width)), Order.of(padded([w[::-1] for w in words], width))
    letters = padded(words, width)
    edited = np.flatnonzero(short)
    for inserts, chosen in ((False, short), (True, ~short)):
        if not chosen.any():
            continue
        points = Points.of(chosen, forward, backward)
        for i in range(lo, hi if inserts else min(hi, size)):
            x = [points.upto[0][e] for e in forward.interval(i)]
            y = [points.upto[1][e] for e in backward.interval(size - i if inserts else size - i - 1)]
            fr, br = forward.rank[edited], backward.rank[edited]
            for k in range(0, len(edited), RECTANGLES):
                part = slice(k, k + RECTANGLES)
                own, value = points.tree.report(x[0][fr[part]], x[1][fr[part]], y[0][br[part]], y[1][br[part]])
                a, b = edited[part][own], points.by_second[value]
                if inserts:  # of equal letters in a row the first counts as inserted
                    keep = letters[b, i] != letters[b, i - 1] if i else np.ones(len(b), bool)
                    a, b = a[keep], b[keep]
                    yield np.r_[a, b], np.r_[b, a]
                else:
                    yield a[a != b], b[a != b]


def best_near(words: list[bytes], n: np.ndarray, size: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words with near ones, how many each has, and which of them is most frequent, of equal ones the first in code-point order."""
    count, best = np.zeros(len(words), np.int64), np.full(len(words), -1)
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    for a, b in near_pairs(words, size, lo, hi):
        count += np.bincount(a, minlength=len(words))
        has = best >= 0
        a, b = np.r_[a, np.flatnonzero(has)], np.r_[b, best[has]]
        order = np.lexsort((rank[b], -n[b], a))
        a, b = a[order], b[order]
        first = np.r_[True, a[1:] != a[:-1]] if len(a) else np.zeros(0, bool)
        best[a[first]] = b[first]
    found = np.flatnonzero(count)
    return found, count[found], best[found]


def search_groups(tree_chars: int):
    """A function over Arrow batches sorted by group: whole groups of the same positions share one tree, up to `tree_chars` letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        words: list[bytes] = []
        counts: list[int] = []
        chars, key = 0, None

        def out() -> Iterator[pa.RecordBatch]:
            if len(words) > 1:
                n = np.array(counts, np.int64)
                found, near, best = best_near(words, n, *held)
                text = lambda at: pa.array([words[i].decode("latin-1") for i in at], pa.string())
                yield pa.RecordBatch.from_arrays([text(found), pa.array(near), text(best), pa.array(n[best])], names=["word", "near", "form", "form_n"])

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(6)]
            for size, lo, hi, k, word, n in zip(*cols, strict=True):
                if held != (size, lo, hi) or (k != key and chars > tree_chars):
                    yield from out()
                    words, counts, chars = [], [], 0
                held, key = (size, lo, hi), k
                words.append(word.encode("latin-1")), counts.append(n)
                chars += len(word)
        yield from out()

    return run


# --- forms ----------------------------------------------------------------------------------------


def near_words(words: DataFrame, scratch: Scratch, group_chars: int = GROUP_CHARS, tree_chars: int = TREE_CHARS) -> DataFrame:
    """(word, n_near, form, form_n) of the words with near ones; `form` is the most frequent, whatever its frequency."""
    entries = bounded_groups(words, scratch, group_chars).select(*GROUP, "word", "n")
    dealt = entries.repartition(*GROUP).sortWithinPartitions(*GROUP)
    found = with_code(dealt).mapInArrow(search_groups(tree_chars), "word string, near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.less")).alias("form_n"))


def roots(forms: DataFrame, scratch: Scratch, most: int) -> DataFrame:
    """(word, root) of (word, form): each form is TIMES as frequent as its word, so a chain has few links, and following it doubles with each join."""
    links = 1
    while LEAST_COUNT * TIMES**links <= most:
        links += 1
    up, reach, k = scratch.table(forms.select("word", F.col("form").alias("root")), "up-0"), 1, 0
    while reach < links:
        k, reach = k + 1, 2 * reach
        further = up.select(F.col("word").alias("at"), F.col("root").alias("next"))
        up = scratch.table(up.join(further, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root")), f"up-{k}")
    return up


def spelling_variants(docs: DataFrame, scratch: Scratch, group_chars: int = GROUP_CHARS, tree_chars: int = TREE_CHARS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of `docs` (doc_id, text) with LEAST_LENGTH letters and LEAST_COUNT occurrences or more.

    Words are near if one inserted, deleted or replaced letter turns one into the other. A word's form is its most
    frequent near word (of equal ones the first in code-point order) if that is TIMES as frequent, else null; its root is
    where following forms ends, the word itself without a form.

    Defined cases: null and empty texts have no words, a null doc_id is written as the empty string before a run; a row
    that comes twice counts twice; words may be of any length; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    words = scratch.table(vocabulary(docs.select("doc_id", "text")), "words")
    near = scratch.table(near_words(words, scratch, group_chars, tree_chars), "near")
    both = words.join(near, "word", "left")
    fits = F.col("form_n") >= TIMES * F.col("n")
    own = both.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    own = scratch.table(own, "forms")
    most = own.agg(F.max("n")).first()[0] or 0
    ends = roots(own.where("form IS NOT NULL"), scratch, most)
    return own.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all of `documents` with their near words, forms and roots."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spelling_variants(docs, Scratch(spark, "variants")).select("word", "form", "root", "n", "n_near", "form_n")


#: The same by joins on words that lack a letter; the check sum comes from a table of bytes.
OP13_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)
  )
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), kinds AS (
  SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS s, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL
), bytes AS (
  SELECT run, n, flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)] END)) AS b FROM kinds
), hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, CAST(b AS BIGINT[])), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc_table
), cut AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gaps AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, g.rest FROM gaps g JOIN words w ON w.word = g.rest
  UNION SELECT g.rest, g.word FROM gaps g JOIN words w ON w.word = g.rest
), best AS (
  SELECT near.word, count(*) AS n_near, arg_min(other, (-w.n, encode(other))) AS form, max(w.n) AS form_n FROM near JOIN words w ON w.word = other GROUP BY near.word
), forms AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)
), path AS (
  SELECT word, word AS upto FROM forms UNION ALL SELECT path.word, forms.form FROM path JOIN forms ON forms.word = path.upto WHERE forms.form IS NOT NULL
), ends AS (
  SELECT path.word, upto AS root FROM path JOIN forms ON forms.word = upto WHERE forms.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
