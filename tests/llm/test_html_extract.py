import random
import re

import pytest
from pyspark.sql import functions as F

from driftcurve.llm import html_extract as H
from driftcurve.llm.storage import Scratch

SCHEMA = "page_id bigint, url string, html string, host string, template string"
RND = random.Random(0)


def sentence(n=12):
    return " ".join("".join(RND.choice("abcdefgh") for _ in range(RND.randrange(2, 8))) for _ in range(n)) + "."


def page(body: list[str], kind: int) -> str:
    nav = "<nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav>"
    if kind == 0:
        text = "".join(f"<p>{b}</p>" for b in body)
        return f"<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><header><h2>Site</h2></header>{nav}<div class='ad'>{sentence()}</div><article>{text}<div class='comments'><p>{sentence()}</p></div></article><aside>{sentence()}</aside><form><label>Mail</label></form><footer>&copy; {sentence(3)}</footer></body></html>"
    text = "".join(f"<div>{b}</div>" for b in body)
    return f"<html><body><div id='top'><a href='/'>Start</a> <a href='/x'>More</a></div><div id='wrap7'><div class='txt'>{text}</div></div><div>All about our site and why you should stay here for a long while.</div><p class='cookie-notice'>{sentence()}</p></body>"


def run(spark, rows):
    got = H.extract(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()
    assert all(r.n_chars == len(r.text) for r in got)
    return {r.page_id: r.text for r in got}


@pytest.mark.parametrize("kind", [0, 1])
def test_articles_of_templated_hosts(spark, kind):
    bodies = [[sentence() for _ in range(RND.randrange(1, 6))] for _ in range(40)]
    rows = [(i, f"https://h{i % 3}.example.com/{i}", page(b, kind), None, None) for i, b in enumerate(bodies)]
    got = run(spark, rows)
    assert all(got[i] == " ".join(b) for i, b in enumerate(bodies))


def test_text_that_every_page_repeats_belongs_to_the_template(spark):
    rows = [(i, "http://x.org/", f"<body><article><p>{(s := sentence())}</p><p class=end>Thanks for reading us.</p></article></body>", s, None) for i in range(5)]
    got = run(spark, rows)
    assert all(got[i] == s for i, _, _, s, _ in rows)
    same = [(i, "http://x.org/", "<body><article><p>One text.</p></article></body>", None, None) for i in range(5)]
    assert set(run(spark, same).values()) == {"One text."}


def test_sums_tell_equal_vectors_from_others(spark):
    pages = [(i, "h", i * 2654435761 * 97 + 5, "<body>" + "<p>a</p>" * (i % 4) + "<h1>b</h1>" * (i % 4) + "<pre>c</pre>" * (3 - i % 4) + "</body>") for i in range(12)]
    parsed = H.parsed_pages(spark.createDataFrame(pages, "page_id bigint, host string, key bigint, html string"))
    stats = {r.path: r for r in H.token_statistics(parsed.withColumn("layout", F.lit(""))).collect()}
    vectors = {p: tuple(H.page_tokens(H.parsed_page(x)).get(p, [0])[0] for *_, x in pages) for p in stats if p}
    for a in vectors:
        for b in vectors:
            assert (vectors[a] == vectors[b]) == ((stats[a].low, stats[a].high) == (stats[b].low, stats[b].high))
    found = H.deduce([r.asDict() for r in stats.values()])
    tokens = [set(c["tokens"]) for c in found["classes"]]
    assert {"body/p", "body/h1"} in tokens and {"body/pre"} in tokens and found["classes"][tokens.index({"body/pre"})]["parent"] == 1


def test_characters_blocks_and_white_space():
    text = H.main_blocks("<article>a<b>b</b>c &amp;lt; &#233;&nbsp;\n\t x<br>next<p>one<p>two <i>th<u>r</i>ee</article>", {"keep": {}})
    assert text == ["abc &lt; é x", "next", "one", "two three"]


def test_edge_cases(spark):
    assert H.extract(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
    deep = "<div>" * 3000 + "deep text here" + "<nav><div>menu</div></nav>" + "</div>" * 3000
    rows = [(1, None, None, None, None), (2, "", "", "h", "t"), (3, "http://a.b/", "<article><p>cut <a href=\"x", None, None), (4, "http://a.b/", deep, None, None), (5, "http://c.d/", "plain < text > & more", None, None), (None, "http://e.f/", "<main>m<script>x", None, None), (6, "http://e.f/", "<p>" + "word " * 200_000, None, None), (6, "http://e.f/", "<p>" + "word " * 200_000, None, None), (7, "http://g.h/", "<article><!-- c -- ></article><p>after", None, None)]
    got = run(spark, rows)
    assert got[1] == got[2] == "" and got[3] == "cut" and got[4] == "deep text here" and got[5].startswith("plain") and got[None] == "m" and len(got[6]) == 999_999


def test_words_of_the_template_are_no_text(spark):
    rows = [(i, "http://w.org/", f"<body><div class=main-text><div class=by>Posted by {(a := sentence(2))} in {(b := sentence(2))}</div><div class=t>{(s := sentence())}</div></div></body>", f"{a} {b} {s}", None) for i in range(20)]
    got = run(spark, rows)
    assert all(got[i] == s for i, _, _, s, _ in rows)


def test_a_listed_name_on_a_wrapper_has_no_say(spark):
    rows = [(i, "http://v.org/", f"<body class='with sidebar'><form><div class=x><p>{(s := sentence())}</p></div><div class=sidebar>Always the same words.</div></form></body>", s, None) for i in range(8)]
    got = run(spark, rows)
    assert all(got[i] == s for i, _, _, s, _ in rows)


def test_pages_without_a_text_or_in_another_layout_do_not_save_a_notice(spark):
    note = "<div class=info><p>All rights are with us and our friends.</p></div>"
    rows = [(i, "http://u.org/", f"<body><div class=x><div class=c><p>{(s := sentence(30))}</p></div>{note if i != 7 else ''}</div></body>", s, None) for i in range(30)]
    rows += [(100, "http://u.org/", "", "", None), (101, "http://u.org/", None, "", None), (102, "http://u.org/", f"<body><pre>{(s := sentence())}</pre></body>", s, None)]
    got = run(spark, rows)
    assert all(got[i] == s for i, _, _, s, _ in rows if i < 102)


def test_a_layout_on_few_of_a_hosts_pages_is_deduced(spark):
    note = "<div class=info><p>All rights are with us and our friends.</p></div>"
    rows = [(i, "http://s.org/", f"<body><div class=a><p>{(s := sentence())}</p></div><div class=b></div></body>", s, None) for i in range(250)]
    rows += [(1000 + i, "http://s.org/", f"<body><section class=k><div class=c><p>{(s := sentence())}</p></div>{note}</section></body>", s, None) for i in range(7)]
    got = run(spark, rows)
    assert all(got[i] == s for i, _, _, s, _ in rows)


def name():
    """A class name that says nothing."""
    return "q" + "".join(RND.choice("bcdfgkvwxz") for _ in range(7))


def nameless_site(n, words=14):
    """Pages of one host whose elements have names that say nothing, and no main element; each with its text."""
    outer, menu, by, body, note, foot, side = (name() for _ in range(7))
    fixed, rights = sentence(9), sentence(6)
    out = []
    for i in range(n):
        paragraphs = [sentence(words) for _ in range(RND.randrange(2, 6))]
        a, b = sentence(2), sentence(2)
        text = [f"{a} {b}", *paragraphs]
        html = f"<body><div class={outer}><div class={menu}><div>Start here now</div><div>All news today</div></div><div class={by}><div>Posted by {a} under {b}</div>" + "".join(f"<div class={body}>{p}</div>" for p in paragraphs)
        html += f"</div><div class={note}><div>{fixed}</div>" + (f"<div class={side}>{sentence(2)}</div>" if i % 3 else "") + f"</div></div><div class={foot}>{rights}</div></body>"
        out.append((html, " ".join(text)))
    return out


def plain_deduction(pages):
    """Classes, fixed blocks and kept slots from explicit occurrence vectors, page by page; then each page's text."""
    pages = [[*H.blocks_of(p)] for p in pages]
    paths = {p for page in pages for p, t, _ in page if not t}
    vector = {p: tuple(sum(q == p and not t for q, t, _ in page) for page in pages) for p in paths}
    on = lambda p: {i for i, n in enumerate(vector[p]) if n}
    held = {p for p in paths if len(on(p)) >= 2}
    up = lambda p: p.rpartition("/")[0]
    cls = {}
    for p in sorted(held, key=lambda p: p.count("/")):
        joins = up(p) in cls and vector[up(p)] == vector[p]
        cls[p] = cls[up(p)] if joins else (vector[p], cls.get(up(p)))
    fixed, words, left = set(), {}, {}
    for p in held:
        blocks = [(i, t, n) for i, page in enumerate(pages) for q, t, n in page if q == p and t]
        for t in {t for _, t, _ in blocks}:
            if len({i for i, u, _ in blocks if u == t}) >= 0.9 * len(on(p)):
                fixed.add((p, t))
        left[p] = sum(len(t) - n for _, t, n in blocks if (p, t) not in fixed)
        every = [t.split() for _, t, _ in blocks]
        for w in {w for x in every for w in x}:
            with_it = {i for i in on(p) if (own := [u.split() for j, u, _ in blocks if j == i]) and all(x.count(w) == 1 for x in own)}
            if len(with_it) >= max(10, 0.9 * len(on(p))):
                words.setdefault(p, []).append((sum(x.index(w) for x in every if w in x), w))
    slots = [p for p in left if left[p] > 0]
    best = max({up(p) for p in slots}, key=lambda u: (sum(left[p] for p in slots if up(p) == u), u))
    keep = {p for p in slots if up(p) == best or p.startswith(f"{best}/")}
    texts = []
    for page in pages:
        out = []
        for p, t, _ in page:
            if t and p in keep and (p, t) not in fixed:
                left_words = t.split()
                for _, w in sorted(words.get(p, [])):
                    left_words.remove(w)
                out.append(" ".join(left_words))
        texts.append(" ".join(out))
    return cls, fixed, texts


@pytest.mark.parametrize("n", [12, 30])
def test_nameless_templates_equal_a_plain_deduction(spark, n):
    """No element name says anything here: classes, their blocks and words and the slots between them decide alone."""
    site = nameless_site(n)
    cls, fixed, texts = plain_deduction([x for x, _ in site])
    rows = [(i, "http://n.org/", x, None, None) for i, (x, _) in enumerate(site)]
    got = run(spark, rows)
    assert [got[i] for i in range(n)] == texts == [t for _, t in site]
    assert not any("Posted" in t or "Start here" in t for t in texts)
    off = [" ".join(H.main_blocks(x, {"keep": {}})) for x, _ in site]
    assert all(a != b and len(a) > len(b) for a, b in zip(off, texts, strict=True))  # without the template all of it stays
    parsed = H.parsed_pages(spark.createDataFrame([(i, "h", i * 7919 * 2654435761 + 1, x) for i, (x, _) in enumerate(site)], "page_id bigint, host string, key bigint, html string"))
    found = H.deduce([r.asDict() for r in H.token_statistics(parsed.withColumn("layout", F.lit(""))).collect()])
    of = {p: k for k, c in enumerate(found["classes"]) for p in c["tokens"] if p}
    assert set(of) == set(cls) and all((of[a] == of[b]) == (cls[a] == cls[b]) for a in of for b in of)
    assert {t for c in found["classes"] for t in c["blocks"]} == {H.block_token(p, t) for p, t in fixed}


def test_columns_say_what_decided(spark):
    site = nameless_site(12)
    rows = [(i, "http://n.org/", x, None, None) for i, (x, _) in enumerate(site)] + [(99, "http://one.org/", "<body><nav>x</nav><article>alone</article></body>", None, None)]
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()}
    assert all((r.n_fixed, r.n_cut, r.n_named) == (4, 1, 0) for i, r in got.items() if i < 99)
    assert (got[99].text, got[99].n_fixed, got[99].n_named) == ("alone", 0, 2)


def test_deep_elements_keep_their_names_and_apart():
    inner = "<div>" * 200
    page = f"<body>{inner}<nav>{'<div>' * 100}menu{'</div>' * 100}</nav><article>{'<div>' * 100}text{'</div>' * 100}</article></div></body>"
    blocks = [b for b in H.blocks_of(page) if b[1]]
    assert [H.standing(p) for p, _, _ in blocks] == ["drop", "main"] and blocks[0][0] != blocks[1][0]
    assert max(len(p) for p, _, _ in H.blocks_of("<div class=abc>" * 20_000)) < 1000
    assert H.main_blocks(page, {"keep": {}}) == ["text"]


def without_names(page):
    """The page with classes, ids and roles as letters that say nothing, and sections as plain divs."""
    import hashlib

    def attribute(m):
        words = (m[2] or m[3] or m[4] or "").split()
        return m[1] + '="' + " ".join("k" + hashlib.md5(w.encode()).hexdigest()[:6].translate(H.LETTERS) for w in words) + '"'

    def tag(m):
        plain = re.sub(r"^(</?)(?:article|main|header|footer|nav|aside|section)\b", r"\1div", m[0], flags=re.I)
        return re.sub(r"\b((?:class|id|role)\s*=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", attribute, plain, flags=re.I)

    return re.sub(r"</?[a-zA-Z][^<>]*>", tag, page) if page else page


def test_templates_decide_on_the_given_pages(spark):
    """Names overrule the template on few blocks, and without any names nearly all pages give the same text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    rows = pages.collect()
    got = {r.page_id: r for r in H.extract(pages, Scratch(spark, "t")).collect()}
    blocks = sum(len([b for b in H.blocks_of(r.html) if b[1]]) for r in rows)
    assert sum(r.n_named for r in got.values()) < 0.1 * blocks
    hidden = spark.createDataFrame([(r.page_id, r.url, without_names(r.html)) for r in rows], "page_id bigint, url string, html string")
    again = {r.page_id: r for r in H.extract(hidden, Scratch(spark, "t")).collect()}
    alike = [i for i in got if got[i].text == again[i].text]
    assert len(alike) >= 0.95 * len(rows)
    assert not any("©" in again[i].text for i in alike)  # no footer is left
    assert all(again[i].n_named > 0 for i in got if i not in alike)  # the others have no page to be compared with


def test_names_overrule_a_template_and_are_counted(spark):
    rows = [(i, "http://c.org/", f"<body><article><p>{(s := sentence())}</p></article><div class=comments><p>{sentence(90)}</p><p>{sentence(90)}</p></div></body>", s, None) for i in range(6)]
    got = {r.page_id: r for r in H.extract(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t")).collect()}
    assert all((got[i].text, got[i].n_named) == (s, 3) for i, _, _, s, _ in rows)


def test_nameless_sections_are_told_apart_by_their_order():
    paths = [p for p, t, _ in H.blocks_of("<body><div>a</div><div>b<div>c</div><div>d</div></div><p>e</p><div class=x>f</div><div class=x>g</div></body>") if t]
    assert paths == ["body/div", "body/div.~b", "body/div.~b/div", "body/div.~b/div.~b", "body/p", "body/div.x", "body/div.x"]
    assert {H.unnumbered(p) for p in paths} == {"body/div", "body/div/div", "body/p", "body/div.x"} and H.layout_of(paths) == H.layout_of(map(H.unnumbered, paths))
    slots = {"b/div/p": 900, "b/div.~b/p": 700, "b/div.~c/p": 20, "b/div.~b/ul/li": 50, "b/div.~d": 40}
    assert H.region_of(list(slots), slots) == {"b/div/p", "b/div.~b/p", "b/div.~b/ul/li"} and H.region_of([], {}) == set()
