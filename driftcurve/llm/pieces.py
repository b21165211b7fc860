"""SentencePiece encoding and decoding with N-best segmentation: forward Viterbi, then backward A-star."""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftcurve.session import with_code

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NBEST = 4
#: Segmented units that a task keeps, in each of two generations: about 180 MB in all.
CACHE = 1 << 18
SPACE = "▁"


def read_model(path: str = MODEL) -> list[tuple[str, float, str]]:
    """A model file's pieces as (text, score, kind); kind is normal, byte or other. Read on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if m.is_byte(i) else "other" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal"
    return [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]


def log_probabilities(model: list[tuple[str, float, str]]) -> list[float]:
    """Scores that a segmentation sums.

    A unigram model's scores are log probabilities and stay. A BPE model's are the negative ranks of its
    merges; there a piece's probability is taken by Zipf's law from its rank. Pieces without a rank
    stand after the last one, and bytes ten nats below all others, so that they only fill gaps.
    """
    scores = [s for _, s, kind in model if kind == "normal" and s > -1e8]
    ranked = bool(scores) and all(s == int(s) and s <= 0 for s in scores) and min(scores) < -100
    if not ranked:
        low = min(scores, default=0.0)
        out = [s if kind == "normal" and s > -1e8 else low for _, s, kind in model]
    else:
        n = len(model)
        whole = math.log(math.log(n) + 0.5772156649015329)
        out = [-math.log(1 + (-s if s > -1e8 else n)) - whole for _, s, _ in model]
        low = min(out)
    return [low - 10 if kind == "byte" else s for s, (_, _, kind) in zip(out, model, strict=True)]


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def unpacked(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<i4")


class Segmenter:
    """Segments texts into pieces of a model by the sum of their scores.

    A text gets one space in front, as the model's own encoder adds, and is cut into units that no
    piece crosses: a word with the spaces before it, a line break, trailing spaces. Units are
    independent, so a text's N best segmentations are N best sums over its units.
    """

    def __init__(self, model: list[tuple[str, float, str]]):
        scores = log_probabilities(model)
        self.raw: list[bytes] = []
        self.byte: dict[int, int] = {}
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        self.piece: dict[str, tuple[float, bytes]] = {}
        inner = breaks = False
        for i, (piece, _, kind) in enumerate(model):
            if kind == "byte":
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
                continue
            text = piece.replace(SPACE, " ") if kind == "normal" else ""
            self.raw.append(text.encode())
            if text:
                self.automaton.add_word(text, (len(text), scores[i], packed([i])))
                self.piece[text] = scores[i], packed([i])
                self.single |= {text} if len(text) == 1 else set()
                inner |= " " in text.lstrip(" ")
                breaks |= "\n" in text and len(text) > 1
        self.automaton.make_automaton()
        self.longest = max(map(len, self.piece), default=1)
        self.covered = self.single.issuperset
        self.byte_score = scores[next(iter(self.byte.values()))] if self.byte else 0.0
        self.unit = re.compile(r"(?s).+") if inner else re.compile(r"(?s) *[^ ]+| +") if breaks else re.compile(r"(?s)\n| *[^ \n]+| +")
        self.young: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}

    def lattice(self, u: str) -> tuple[list[tuple], list[float], list[tuple | None]]:
        """Arcs (start, end, score, ids) by end, and Viterbi on the way: each position's best score and the arc that reaches it.

        All pieces that occur come from one pass of an Aho-Corasick automaton. A character that is no
        piece becomes its bytes.
        """
        n = len(u)
        best, by = [0.0] + [-math.inf] * n, [None] * (n + 1)
        arcs = [(end + 1 - length, end + 1, s, ids) for end, (length, s, ids) in self.automaton.iter(u)]
        if not self.covered(u):
            for i, c in enumerate(u):
                if c not in self.single:
                    b = c.encode("utf-8", "surrogatepass")
                    arcs.append((i, i + 1, self.byte_score * len(b), packed([self.byte[x] for x in b])))
            arcs.sort(key=itemgetter(1))
        for arc in arcs:
            i, j, s, _ = arc
            s += best[i]
            if s > best[j]:
                best[j], by[j] = s, arc
        return arcs, best, by

    def solve(self, u: str) -> tuple[bytes, float, float]:
        """A unit's best ids (packed), their score, and how far behind the second best lies (inf if there is none).

        Viterbi with the two best scores of each position; of the second only the score is needed.
        """
        n = len(u)
        best, second = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1)
        start, ids_at = [0] * (n + 1), [b""] * (n + 1)
        if self.covered(u):
            arcs = self.automaton.iter(u)
        else:
            arcs = [(j - 1, (j - i, s, ids)) for i, j, s, ids in self.lattice(u)[0]]
        for end, (length, s, ids) in arcs:
            j = end + 1
            i = j - length
            v, top = best[i] + s, best[j]
            if v > top:
                t = second[i] + s
                second[j] = top if top > t else t
                best[j], start[j], ids_at[j] = v, i, ids
            elif v > second[j]:
                second[j] = v
        if not (at := start[n]):
            return ids_at[n], best[n], best[n] - second[n]
        path = [ids_at[n]]
        while at:
            path.append(ids_at[at])
            at = start[at]
        path.reverse()
        return b"".join(path), best[n], best[n] - second[n]

    def viterbi(self, u: str) -> list[float]:
        """Each position's best score; arcs are read one by one and not kept."""
        best = [0.0] + [-math.inf] * len(u)
        arcs = self.automaton.iter(u) if self.covered(u) else [(j - 1, (j - i, s, ids)) for i, j, s, ids in self.lattice(u)[0]]
        for end, (length, s, _) in arcs:
            if (v := best[end + 1 - length] + s) > best[end + 1]:
                best[end + 1] = v
        return best

    def arcs_into(self, u: str, j: int, best: list[float]) -> list[tuple[float, int, float, bytes]]:
        """The arcs that end at a position, the best first: the score of the best way through each, its start, its own score, its ids."""
        found = []
        for i in range(j - 1, max(-1, j - 1 - self.longest), -1):
            if (e := self.piece.get(u[i:j])) is not None:
                found.append((best[i] + e[0], i, *e))
        if u[j - 1] not in self.single:
            b = u[j - 1].encode("utf-8", "surrogatepass")
            s = self.byte_score * len(b)
            found.append((best[j - 1] + s, j - 1, s, packed([self.byte[x] for x in b])))
        found.sort(key=lambda a: (-a[0], a[1]))
        return found

    def nbest_unit(self, u: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of a unit, by A-star from its end back to its start.

        What remains before a position is worth exactly its forward Viterbi score, so hypotheses leave the
        queue in the order of their complete scores and each one that arrives at the start is the next best.
        A hypothesis stands for the best not yet tried way into its position: when it leaves the queue it
        puts in its next sibling and its own first child, no more. Of equal scores the one nearest the
        start goes first, and a position that was left n times is left no more (n better ways through it
        are known), so that long runs of ties cost at most n steps a position.
        """
        best = self.viterbi(u)
        into: dict[int, list[tuple[float, int, float, bytes]]] = {}
        left: dict[int, int] = {}
        queue: list[tuple] = []
        count = 0

        def put(at: int, rank: int, done: float, tail: tuple | None) -> None:
            nonlocal count
            if at not in into:
                into[at] = self.arcs_into(u, at, best)
            if rank < len(into[at]):
                total, i, s, ids = into[at][rank]
                count += 1
                heapq.heappush(queue, (-(total + done), i, count, at, rank, done, s, ids, tail))

        put(len(u), 0, 0.0, None)
        out: list[tuple[float, bytes]] = []
        while queue and len(out) < n:
            _, i, _, at, rank, done, s, ids, tail = heapq.heappop(queue)
            put(at, rank + 1, done, tail)
            if left.get(i, 0) >= n:
                continue
            left[i] = left.get(i, 0) + 1
            own = (ids, tail)
            if i:
                put(i, 0, done + s, own)
                continue
            parts = []
            while own is not None:
                parts.append(own[0])
                own = own[1]
            out.append((done + s, b"".join(parts)))
        return out

    def lookup(self, u: str) -> tuple:
        if (e := self.young.get(u)) is None:
            if (e := self.old.get(u)) is None:
                e = self.solve(u)
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[u] = e
        return e

    def encode(self, text: str | None, n: int = NBEST) -> tuple[np.ndarray, float, list[tuple[float, list[tuple[int, bytes]]]]]:
        """The best ids, their score, and the next n - 1: each its score and the units (by number) that it segments otherwise, with their packed ids."""
        if not text:
            return np.empty(0, np.int32), 0.0, []
        units = self.unit.findall(" " + text)
        get = self.young.get
        packs, scores, gaps = zip(*[get(u) or self.lookup(u) for u in units], strict=True)
        score, gap = float(np.array(scores).sum()), np.array(gaps)
        k = min(n - 1, len(gap))
        close = np.argpartition(gap, k - 1)[:k].tolist() if k else []
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for k in sorted(i for i in close if gaps[i] < math.inf):
            own = self.nbest_unit(units[k], n)
            sums = heapq.nsmallest(n, [(b + own[0][0] - s, (*c, (k, ids)) if j else c) for b, c in sums for j, (s, ids) in enumerate(own)], key=itemgetter(0))
        return unpacked(b"".join(packs)), score, [(score - b, list(c)) for b, c in sums[1:n]]

    def nbest(self, text: str | None, n: int = NBEST) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a text in full: (score, ids), best first."""
        ids, score, more = self.encode(text, n)
        units = self.unit.findall(" " + text) if text else []
        out = [(score, ids.tolist())]
        for s, changes in more:
            other = dict(changes)
            out.append((s, unpacked(b"".join(other.get(i) or self.lookup(u)[0] for i, u in enumerate(units))).tolist()))
        return out

    def decode(self, ids) -> str:
        ids = ids.tolist() if isinstance(ids, np.ndarray) else ids
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


SCHEMA = "doc_id bigint, ids array<int>, n_pieces bigint, score double, alternatives array<struct<score:double,changes:array<struct<unit:int,ids:array<int>>>>>, round_trip boolean"


def encode_documents(docs: DataFrame, model_path: str = MODEL, n: int = NBEST) -> DataFrame:
    """Each row's whole text as pieces: doc_id, ids, n_pieces, score, alternatives, round_trip.

    `ids` is the best segmentation. `alternatives` are the next n - 1, fewer if a text has fewer, each
    with its score and the units (counted from 0) whose pieces differ from the best. `round_trip` says
    whether the ids decode to the text exactly.

    Defined cases: null and empty texts have no pieces, score 0 and no alternatives; a literal U+2581
    and characters outside the vocabulary become bytes; equal scores keep the order in which the search
    meets them, the same on every run; rows that repeat a doc_id each come back; a null doc_id stays
    null; an empty table gives an empty one; other columns are ignored. Line breaks and runs of spaces
    are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_model(model_path))  # as large as the model file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(shared.value)
        change = pa.struct([("unit", pa.int32()), ("ids", pa.list_(pa.int32()))])
        other = pa.struct([("score", pa.float64()), ("changes", pa.list_(change))])
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                ids, scores, more, fine = [], [], [], []
                for i in range(b.num_rows):
                    text = b.column(1)[i].as_py() or ""
                    got, score, rest = segmenter.encode(text, n)
                    ids.append(got)
                    scores.append(score)
                    more.append([{"score": s, "changes": [{"unit": k, "ids": unpacked(x)} for k, x in c]} for s, c in rest])
                    fine.append(segmenter.decode(got) == text)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
                counts = pa.array(np.diff(ends).astype(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, counts, pa.array(scores, pa.float64()), pa.array(more, pa.list_(other)), pa.array(fine)], names=["doc_id", "ids", "n_pieces", "score", "alternatives", "round_trip"])

    return with_code(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string"))).mapInArrow(run, SCHEMA)


def decode_documents(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) of an encoded table; null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_model(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(shared.value)
        for b in batches:
            texts = [None if (x := b.column(1)[i].as_py()) is None else segmenter.decode(x) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return with_code(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id bigint, text string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best segmentation of all of `documents` and the three next best."""
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
