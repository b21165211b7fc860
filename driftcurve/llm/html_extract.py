"""HTML extraction by template deduction: elements, text blocks and words with equal occurrence vectors form classes, classes nest into a host's template, its slots hold the text."""

from __future__ import annotations

import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from driftcurve.llm.storage import Scratch
from driftcurve.session import with_code

#: Occurrence vectors compare pages: a layout needs two, and a token of a template stands on two at least.
MIN_PAGES = 2
LINKED = 0.5
#: A word joins the template only on this many pages: on fewer, a common word may stand once in every text by chance.
WORD_PAGES = 10
#: A name that would drop this share of a host's slot text sits on a wrapper and says nothing.
OUTER = 0.9
#: A text belongs to its class if it stands on this share of the pages that hold the class.
NEARLY = 0.9
#: Sections at one path are of one kind if the smaller one's text is this share of the larger one's.
LIKE = 0.2
#: Steps that a path spells out at its start and at its end; those between are one step with their hash and what their names say.
ENDS = 32

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|=(?!\s*[\"'])|[^>=])*+)(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "body", "blockquote", "aside", "nav", "footer", "header", "form"}

#: Elements whose places tell the layouts of a host apart.
SECTIONS = {"html", "body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "center", "frameset"}

DROP_TAGS = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "audio", "video", "canvas"} | RAW
MAIN = re.compile(r"^(article|main)\b|\b(role=main|article(-?body|-?content|-?text)?|post-?(body|content)|entry-?content|main-?(content|text)|story-?body)\b")
DROP = re.compile(
    r"(?:^|[.#=_\- ])(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar|side-bar|widget|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|comments?|comment-?\w*|respond|replies|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|skip|copyright|navigation|complementary|contentinfo)(?=$|[.#=_\- ])"
)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def step_of(tag: str, attributes: str) -> str:
    """An element in a path: its tag with role, id and classes, digits left out."""
    if "=" not in attributes:
        return tag
    found = {k.lower(): (a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)}
    step = tag + (f".role={found['role']}" if found.get("role") else "") + (f"#{found['id']}" if found.get("id") else "") + "".join(f".{c}" for c in found.get("class", "").split())
    return re.sub(r"[\d\n]+", "", step.lower()).replace("/", "")


@lru_cache(1 << 16)
def said(step: str) -> str:
    """What one element's names say: drop, main, header (a drop outside of a main element) or open."""
    tag = re.match(r"[^.#]*", step)[0]
    if tag in DROP_TAGS or (step != tag and DROP.search(step[len(tag) :])):
        return "drop"
    return "header" if tag == "header" else "main" if MAIN.search(step) else "open"


@lru_cache(1 << 16)
def standing(path: str, outer: frozenset[str] = frozenset()) -> str:
    """What a path's own names say: drop, main or open. Elements in `outer` have no say."""
    found, at = "open", ""
    for step in path.split("/"):
        at = f"{at}/{step}" if at else step
        if at in outer:
            continue
        own = said(step)
        if own == "drop" or (own == "header" and found != "main"):
            return "drop"
        if own == "main":
            found = "main"
    return found


def middle(says: str, digest: int) -> str:
    """The step that stands for the steps in the middle of a deep path: it says what they say."""
    return {"drop": "div#nav", "main": "div#main-content"}.get(says, "div") + f".~{digest:x}".translate(LETTERS)


#: Digits are no part of a step, so a hash is written in letters.
LETTERS = str.maketrans("0123456789", "ghijklmnop")


ORDINALS = "bcdefgh"
ORDINAL = re.compile(rf"\.~[{ORDINALS}](?=/|$)")


def unnumbered(path: str) -> str:
    """A path without the order of its nameless sections."""
    return ORDINAL.sub("", path) if ".~" in path else path


class Chain:
    """The open elements of a page: their steps, and for each a path of bounded length that tells any two chains apart."""

    def __init__(self) -> None:
        self.steps: list[str] = []
        self.paths: list[str] = []
        self.deep: list[tuple[int, str]] = []  # from step ENDS on: the hash of the steps from there, and what they say
        self.inside: list[dict[str, int]] = [{}]  # of each open element, and of the page, how many sections without a name it has by now

    @property
    def path(self) -> str:
        return self.paths[-1] if self.paths else ""

    def push(self, step: str) -> None:
        """Open an element. Sections that no name tells apart are told apart by their order, up to the eighth."""
        steps = self.steps
        if step in SECTIONS:
            n = self.inside[-1][step] = self.inside[-1].get(step, 0) + 1
            step += f".~{ORDINALS[min(n, 8) - 2]}" if n > 1 else ""
        self.inside.append({})
        steps.append(step)
        n = len(steps) - ENDS
        if n > 0:
            digest, before = self.deep[-1] if self.deep else (0, "open")
            own = said(step)
            says = before if before == "drop" or own == "open" else "drop" if own == "drop" or (own == "header" and before != "main") else "main"
            self.deep.append((hash_of(f"{digest}/{step}"), says))
        if n > ENDS:
            digest, says = self.deep[n - ENDS - 1]
            self.paths.append("/".join([*steps[:ENDS], middle(says, digest), *steps[n:]]))
        else:
            self.paths.append(f"{self.paths[-1]}/{step}" if self.paths else step)

    def cut(self, i: int) -> None:
        del self.steps[i:], self.paths[i:], self.deep[max(0, i - ENDS) :], self.inside[i + 1 :]


def hash_of(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def blocks_of(page: str | None) -> Iterator[tuple[str, str, int]]:
    """A page's tokens in order: (path, text, characters within links).

    An element that opens comes with an empty text. A path is the chain of open block elements; inline elements are no part of it, so one that is
    never closed does no harm. A text block ends where a block element starts or ends, or at a line
    break; character references are decoded and white space becomes single spaces.
    """
    chain = Chain()
    names: list[str] = []
    path = ""
    parts: list[str] = []
    linked = anchor = 0
    at = 0
    page = page or ""

    def flush() -> tuple[str, str, int] | None:
        nonlocal linked
        raw = parts[0] if len(parts) == 1 else "".join(parts)
        text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        parts.clear()
        n, linked = linked, 0
        return (path, text, min(n, len(text))) if text else None

    def close(i: int) -> None:
        nonlocal path
        chain.cut(i)
        del names[i:]
        path = chain.path

    def closed_by(tag: str) -> int:
        return len(names) - 1 - names[::-1].index(tag)

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        raw = page[at : m.start()] if m else page[at:]
        if raw:
            parts.append(raw)
            linked += len(raw) * (anchor > 0)
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        if m[1]:
            parts.append(m[1].replace("&", "&amp;"))
        if not m[3]:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if tag in INLINE:
            if tag == "a":
                anchor = 0 if closing else 1
            continue
        if parts and (block := flush()) is not None:
            yield block
        if closing:
            if tag in names:
                close(closed_by(tag))
                if tag in ("p", "li", "ul", "nav", "div", "article"):
                    anchor = 0
            continue
        if tag in RAW:
            over = re.compile(f"</{tag}\\s*>?", re.I).search(page, at)
            at = over.end() if over else end
        if tag in RAW or tag in VOID:
            own = step_of(tag, m[4]) if tag in RAW else tag
            yield f"{path}/{own}" if path else own, "", 0
            continue
        if tag in CLOSES_P and "p" in names:
            close(closed_by("p"))
        if tag in SAME:
            for i in range(len(names) - 1, -1, -1):
                if names[i] in SAME[tag]:
                    close(i)
                    break
                if names[i] in SCOPES:
                    break
        chain.push(step_of(tag, m[4]))
        names.append(tag)
        path = chain.path
        yield path, "", 0
    if parts and (block := flush()) is not None:
        yield block


# --- templates ----------------------------------------------------------------------------------

STATS = "host string, layout string, path string, pages bigint, times bigint, low bigint, high bigint, chars bigint, linked bigint, place double"


def block_token(path: str, text: str) -> str:
    return f"{path}\n={xxhash.xxh64_hexdigest(text)}"


def word_token(path: str, word: str) -> str:
    return f"{path}\nw{word if len(word) <= 32 else xxhash.xxh64_hexdigest(word)}"


PARSED = "layout string, paths array<string>, opened array<int>, first array<int>, place array<int>, at array<int>, texts array<string>, linked array<int>"


def parsed_page(page: str | None) -> dict[str, list]:
    """A page's elements and text blocks: each path, how often it opens and its first position; each block's path (by number), position, text and linked characters."""
    number: dict[str, int] = {}
    opened: list[int] = []
    first: list[int] = []
    place, at, texts, links = [], [], [], []
    for n, (path, text, linked) in enumerate(blocks_of(page)):
        k = number.get(path)
        if k is None:
            k = number[path] = len(opened)
            opened.append(0)
            first.append(n)
        if text:
            place.append(k)
            at.append(n)
            texts.append(text)
            links.append(linked)
        else:
            opened[k] += 1
    return {"paths": list(number), "opened": opened, "first": first, "place": place, "at": at, "texts": texts, "linked": links}


def page_tokens(x: dict[str, list]) -> dict[str, list]:
    """By token of a parsed page: occurrences, text characters, linked characters, the first position.

    Tokens are the elements, by path; each text block, by path and text; and the words that stand once in
    each block of a path, for only those have the occurrence vector of the block.
    """
    paths = x["paths"]
    out: dict[str, list] = {p: [n, 0, 0, f] for p, n, f in zip(paths, x["opened"], x["first"], strict=True)}
    blocks: dict[int, list[str]] = {}
    for k, n, text, linked in zip(x["place"], x["at"], x["texts"], x["linked"], strict=True):
        own, block = out[paths[k]], out.setdefault(block_token(paths[k], text), [0, 0, 0, n])
        block[0] += 1
        for t in (own, block):
            t[1] += len(text)
            t[2] += linked
        blocks.setdefault(k, []).append(text)
    for k, own in blocks.items():
        words = own[0].split()
        place = {w: i for i, w in enumerate(words)}
        once = set(place) if len(place) == len(words) else {w for w in place if words.count(w) == 1}
        for text in own[1:]:
            if not once:
                break
            words = text.split()
            once = {w for w in once if words.count(w) == 1}
        for w in once:
            out[word_token(paths[k], w)] = [len(own), 0, 0, place[w]]  # in order of the words' places in their blocks
    return out


def layout_of(paths: Iterable[str]) -> str:
    """A page's layout: the sections at the first level below the root that has more than one kind of them."""
    below: dict[str, set[str]] = defaultdict(set)
    for path in map(unnumbered, paths):
        above, _, step = path.rpartition("/")
        if re.match(r"[^.#]*", step)[0] in SECTIONS:
            below[above].add(path)
    at = ""
    while len(below[at]) == 1:
        (at,) = below[at]
    return xxhash.xxh64_hexdigest("\n".join(sorted(below[at]) or [at]))


def parsed_pages(pages: DataFrame) -> DataFrame:
    """Each page parsed: the columns of `pages` (page_id, url, host, key, html) but html, its layout, elements and text blocks."""
    kinds = [("layout", pa.string()), ("paths", pa.list_(pa.string())), *((c, pa.list_(pa.int32())) for c in ("opened", "first", "place", "at")), ("texts", pa.list_(pa.string())), ("linked", pa.list_(pa.int32()))]
    given = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, str] = {}
        for b in batches:
            rows = []
            for page in b.column("html"):
                x = parsed_page(page.as_py())
                shape = tuple(x["paths"])
                if shape not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[shape] = layout_of(shape)
                rows.append(x | {"layout": known[shape]})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in given), *(pa.array([r[c] for r in rows], t) for c, t in kinds)], names=[*given, *(c for c, _ in kinds)])

    types = dict(pages.dtypes)
    return with_code(pages).mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in given) + ", " + PARSED)


def token_statistics(parsed: DataFrame) -> DataFrame:
    """Per host, layout and token what its occurrence vector and texts add up to, combined within each batch first.

    An occurrence vector is represented by its product with a random number per page (in two halves of
    30 bits): equal vectors have equal sums, others practically never, and sums can be aggregated
    without bringing a host's pages together. A page without text tells nothing of a text's support.
    """
    columns = ["host", "layout", "key", "paths", "opened", "first", "place", "at", "texts", "linked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[str, str, str], list] = {}
            for x in b.to_pylist():
                h, tokens = x["key"] & (1 << 60) - 1, page_tokens(x)
                tokens[""] = [1, 0, 0, 0]
                for path, (times, chars, linked, first) in tokens.items():
                    own = total.setdefault((x["host"], x["layout"], path), [0, 0, 0, 0, 0, 0, 0.0])
                    own[0] += 1
                    own[1] += times
                    own[2] += (h & 0x3FFFFFFF) * times
                    own[3] += (h >> 30) * times
                    own[4] += chars
                    own[5] += linked
                    own[6] += first
            rows = [(*k, *v) for k, v in total.items()]
            kinds = [pa.string()] * 3 + [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=STATS.replace(",", "").split()[::2])

    return added(with_code(parsed.where(F.size("texts") > 0).select(columns)).mapInArrow(run, STATS))


def added(stats: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("pages", "times", "chars", "linked", "place")] + [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high")]  # billions of pages would overflow a long
    return stats.groupBy("host", "layout", "path").agg(*sums)


def deduce(rows: list[dict]) -> dict:
    """The template of a host's layout from its tokens' statistics.

    Elements with equal vectors whose parents are in one class form an equivalence class, ordered by
    their mean place; a class nests in its parents' class. The blocks and words that stand on nearly
    all pages of their element's class are tokens of it, too, and belong to the template, unless no
    text differs from page to page. What is left at a path is a slot. The template chooses those in the
    element with the most unlinked text, whatever anything is called. Names overrule it: slots within a main
    element go before others, and one whose name says so goes; `named` are the paths on which they and the
    template's own choice differ. A name that would drop nearly all slots is passed over.
    """
    total = next((r["pages"] for r in rows if r["path"] == ""), 0)
    if total < MIN_PAGES:
        return {"pages": total, "classes": [], "keep": {}}
    own = {r["path"]: r for r in rows if r["path"] and "\n" not in r["path"] and r["pages"] >= MIN_PAGES}
    parent = lambda p: p.rpartition("/")[0]
    of: dict[str, int] = {"": 0}
    classes: list[dict] = [{"tokens": [""], "parent": None, "pages": total, "blocks": [], "words": []}]
    index: dict[tuple, int] = {}
    for path in sorted(own, key=lambda p: (p.count("/"), own[p]["place"] / own[p]["pages"], p)):
        r = own[path]
        above = of.get(parent(path), 0)
        same = (r["low"], r["high"]) == tuple(own[parent(path)][k] for k in ("low", "high")) if parent(path) in own else False
        key = (r["low"], r["high"], classes[above]["parent"] if same else above)
        if same:
            of[path] = above
            classes[above]["tokens"].append(path)
        elif key in index:
            of[path] = index[key]
            classes[index[key]]["tokens"].append(path)
        else:
            index[key] = of[path] = len(classes)
            classes.append({"tokens": [path], "parent": above, "pages": r["pages"], "blocks": [], "words": []})
    for c in classes:
        c["tokens"].sort(key=lambda p: own[p]["place"] / own[p]["pages"] if p else -1)
    texts = {r["path"]: r for r in rows if r["path"] in of and r["chars"]}
    left = {p: [r["chars"], r["linked"]] for p, r in texts.items()}
    for r in sorted((r for r in rows if "\n" in r["path"]), key=lambda r: (r["place"] / r["pages"], r["path"])):
        path, _, token = r["path"].partition("\n")
        if path not in of or not in_class(r, classes[of[path]]["pages"]):
            continue
        if token[0] == "=":
            classes[of[path]]["blocks"].append(r["path"])
            left[path] = [left[path][0] - r["chars"], left[path][1] - r["linked"]]
        elif r["pages"] >= WORD_PAGES:
            classes[of[path]]["words"].append(r["path"])
    if not any(n > 0 for p, (n, _) in left.items() if standing(p) != "drop"):
        for c in classes:
            c["blocks"], c["words"] = [], []
        left = {p: [r["chars"], r["linked"]] for p, r in texts.items()}
    slots = {p: n - linked for p, (n, linked) in left.items() if n > 0}
    under: dict[str, int] = defaultdict(int)
    for p, n in slots.items():
        at = p
        while at:
            under[at] += n
            at = parent(at)
    all_of = sum(slots.values())
    # the template's own choice, whatever anything is called
    unlinked = [p for p in slots if left[p][1] < LINKED * left[p][0]]
    region = region_of(unlinked, slots)
    own_choice = {p: p in region for p in texts}
    outer = frozenset(p for p, n in under.items() if all_of and n >= OUTER * all_of and said(p.rpartition("/")[2]) in ("drop", "header"))
    names = {p: standing(p, outer) for p in slots}
    keep = {p: False for p in texts}
    if main := [p for p, s in names.items() if s == "main"]:
        keep |= dict.fromkeys(main, True)
    else:
        open_slots = [p for p in unlinked if names[p] == "open"]
        keep |= dict.fromkeys(region_of(open_slots, slots), True)
    named = sorted(p for p in keep if keep[p] != own_choice[p])
    return {"pages": total, "main": bool(main), "classes": classes, "outer": sorted(outer), "keep": keep, "named": named}


def region_of(paths: list[str], slots: dict[str, int]) -> set[str]:
    """Of some slots those in the element whose own children hold the most text, and in its like.

    Like it are elements at the same path, but for the order of nameless sections, whose slot at the place of its
    largest one holds a like amount.
    """
    parent = lambda p: p.rpartition("/")[0]
    free: dict[str, int] = defaultdict(int)
    for p in paths:
        free[parent(p)] += slots[p]
    if not free:
        return set()
    best = max(free, key=lambda p: (free[p], p))
    if not best:
        return set(paths)
    inside = lambda p, at: p == at or p.startswith(f"{at}/")
    largest = max((p for p in paths if parent(p) == best), key=lambda p: (slots[p], p))
    alike = {parent(p) for p in paths if unnumbered(p) == unnumbered(largest) and slots[p] >= LIKE * slots[largest]}
    return {p for p in paths if any(inside(p, at) for at in alike)}


def in_class(r: dict, pages: int) -> bool:
    return r["pages"] >= NEARLY * pages


def needed(template: dict) -> dict:
    """What extraction needs of a template: the classes' texts, but not the elements that they were deduced from."""
    return template | {"classes": [{k: c[k] for k in ("blocks", "words")} for c in template["classes"] if c["blocks"] or c["words"]]}


def templates(parsed: DataFrame, scratch: Scratch) -> DataFrame:
    """(template_host, template_layout, template): one row per layout of a host, the template as JSON.

    Each layout is deduced in a task of its own. Layouts on fewer than MIN_PAGES pages are taken
    together as the rest of their host; where that is too small as well, they have the template of
    the host's most frequent layout. The deduction gets elements on MIN_PAGES pages and the texts that
    stand on nearly all pages of their element: at most (mean tokens per page / MIN_PAGES) elements a page.
    """
    text = F.instr("path", "\n") > 0
    stats = token_statistics(parsed)
    stats = scratch.table(stats.select("host", "layout", "path", "pages", "times", "chars", "linked", "place", *(F.when(~text, F.col(c)).alias(c) for c in ("low", "high"))), "tokens", compression="zstd")
    sizes = stats.where("path = ''").select(F.col("host").alias("th"), F.col("layout").alias("tl"), F.col("pages").alias("total"))
    sizes = scratch.table(sizes, "layouts")
    small = F.col("total") < MIN_PAGES
    rest = stats.join(sizes.where(small), (F.col("host") == F.col("th")) & (F.col("layout") == F.col("tl"))).withColumn("layout", F.lit("")).select(stats.columns)
    ready = scratch.table(stats.where(F.col("pages") >= MIN_PAGES).unionByName(added(rest).where(F.col("pages") >= MIN_PAGES)), "ready", compression="zstd")
    scratch.drop("tokens")
    elements = ready.where(~text)
    of = elements.select(F.col("host").alias("eh"), F.col("layout").alias("el"), F.col("path").alias("ep"), F.col("pages").alias("epages"))
    texts = ready.where(text).join(of, (F.col("host") == F.col("eh")) & (F.col("layout") == F.col("el")) & (F.substring_index("path", "\n", 1) == F.col("ep")))
    texts = texts.where(F.col("pages") >= NEARLY * F.col("epages")).select(ready.columns)

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        return pa.table({"host": [rows[0]["host"]], "layout": [rows[0]["layout"]], "template": [json.dumps(needed(deduce(rows)))]})

    found = elements.unionByName(texts).groupBy("host", "layout").applyInArrow(run, "host string, layout string, template string")
    found = scratch.table(found, "deduced")
    scratch.drop("ready")
    main = sizes.where(~small).groupBy("th").agg(F.max_by("tl", F.struct("total", "tl")).alias("main"))
    rests = found.where("layout = ''").select(F.col("host").alias("rh"), F.lit("").alias("rl"))
    of_small = sizes.where(small).join(rests, F.col("th") == F.col("rh"), "left").join(main.withColumnRenamed("th", "mh"), F.col("th") == F.col("mh"), "left").select("th", "tl", F.coalesce("rl", "main").alias("use"))
    use = sizes.where(~small).select("th", "tl", F.col("tl").alias("use")).unionByName(of_small)
    return use.join(found, (F.col("th") == F.col("host")) & (F.col("use") == F.col("layout"))).select(F.col("th").alias("template_host"), F.col("tl").alias("template_layout"), "template")


def prepared(template: dict) -> dict:
    """A template with its classes' text tokens as look-ups: the blocks, and each path's words in order."""
    words: dict[str, list[str]] = defaultdict(list)
    for c in template.get("classes", ()):
        for token in c["words"]:
            path, _, word = token.partition("\n")
            words[path].append(word)
    return template | {"blocks": {t for c in template.get("classes", ()) for t in c["blocks"]}, "words": dict(words), "outer": frozenset(template.get("outer", ())), "named": frozenset(template.get("named", ()))}


def slot_of(path: str, text: str, words: list[str]) -> str:
    """What a block holds besides its template's words; all of it, if it lacks one or has them in another order."""
    parts = text.split()
    found = [word_token("", w)[1:] for w in parts]
    at = -1
    gone = set()
    for w in words:
        try:
            at = found.index(w, at + 1)
        except ValueError:
            return text
        gone.add(at)
    return " ".join(w for i, w in enumerate(parts) if i not in gone)


def main_blocks(page: str | None, template: dict) -> list[str]:
    """The slots of a page: see `extracted`."""
    return extracted([b for b in blocks_of(page) if b[1]], prepared(template))["slots"]


def extracted(found: Iterable[tuple[str, str, int]], template: dict) -> dict:
    """The texts of a page that fill its template's kept slots, and what decided on the other blocks.

    `n_fixed` blocks are the template's own, `n_cut` lost words that are; of the rest, the template's slots
    decide. Where the template lacks an element, the nearest one above it that it has decides, and else
    the element names. So they do on a page with a main element on a host whose template has none, or
    the reverse. `n_named` counts the blocks on which names decided: those without a template's choice, and
    those where it was another.
    """
    keep, outer, fixed, words = (template[k] for k in ("keep", "outer", "blocks", "words"))
    overruled = template["named"]
    decided: dict[str, tuple[bool | None, bool]] = {}

    def by_template(path: str) -> tuple[bool | None, bool]:
        """Whether a path's blocks stay, and whether a name had to say so."""
        if path in decided:
            return decided[path]
        if path in keep:
            got = keep[path], path in overruled
        elif standing(path, outer) == "drop":
            got = False, True
        else:
            got = by_template(path.rpartition("/")[0]) if "/" in path else (None, True)
        decided[path] = got
        return got

    names = {p: standing(p, outer) for p, _, _ in found}
    has_main = any(s == "main" for s in names.values())
    out: dict = {"slots": [], "n_fixed": 0, "n_cut": 0, "n_named": 0}
    for p, t, linked in found:
        if fixed and block_token(p, t) in fixed:
            out["n_fixed"] += 1
            continue
        choice, named = by_template(p)
        if choice is None or has_main != template.get("main", has_main):
            by_name = names[p] == "main" if has_main else names[p] == "open" and linked < LINKED * len(t)
            choice, named = by_name, named or by_name != choice
        out["n_named"] += named
        if choice and p in words:
            rest = slot_of(p, t, words[p])
            out["n_cut"] += rest != t
            t = rest
        if choice and t:
            out["slots"].append(t)
    return out


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(page_id, url, text, n_chars, n_fixed, n_cut, n_named): the main text of every page's whole html.

    Each page is parsed once, into a table of its elements and text blocks. From it templates are deduced
    per layout of a host and joined back; the table of templates is written first, so that its size
    decides how it is joined. `n_fixed` blocks were taken out as the template's, `n_cut` lost the template's
    words, and on `n_named` element names had a say.

    Defined cases: null, empty and textless pages have the empty text; a page without another of its host
    to compare it with goes by element names alone; null urls and urls without a host form one host; broken
    markup is read as far as it goes (an element never closed ends with the page); repeated rows each
    come back; an empty table gives an empty one; other columns are ignored.
    """
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.xxhash64(F.col("page_id").cast("string"), "url").alias("key"), F.col("html").cast("string").alias("html"))
    parsed = scratch.table(parsed_pages(own), "parsed", compression="zstd")
    known = scratch.table(templates(parsed, scratch), "templates")
    for used in ("deduced", "layouts"):
        scratch.drop(used)
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str | None, dict] = {}
        for b in batches:
            out = []
            for paths, places, texts, linked, template in zip(*(b.column(j).to_pylist() for j in range(2, 7)), strict=True):
                if template not in cache:
                    if len(cache) > 1000:
                        cache.clear()
                    cache[template] = prepared(json.loads(template) if template else {"keep": {}})
                out.append(extracted([(paths[p], t, n) for p, t, n in zip(places, texts, linked, strict=True)], cache[template]))
            counts = [pa.array([x[c] for x in out], pa.int64()) for c in ("n_fixed", "n_cut", "n_named")]
            texts = [" ".join(x["slots"]) for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), *counts], names=["page_id", "url", "text", "n_chars", "n_fixed", "n_cut", "n_named"])

    joined = parsed.join(known, (F.col("host") == F.col("template_host")) & (F.col("layout") == F.col("template_layout")), "left").select("page_id", "url", "paths", "place", "texts", "linked", "template")
    return with_code(joined).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint, n_fixed bigint, n_cut bigint, n_named bigint")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all of `pages`; nulls, empties, ties, broken markup and repeated rows as `extract` says."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), Scratch(spark, "html"))
