import base64
import gzip
import hashlib
import html
import re
import uuid

import pytest

from driftcurve.llm import warc as W

PAGES = "page_id bigint, url string, html string, block string, record_id int"
HTML = "<html><head><title>A &amp; B</title><style>x{}</style></head><body><h1>Über</h1><p>one  <b>two</b><script>no()</script></p></body></html>"


def digest(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_records_link_to_their_response(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", HTML, None, None), (2, None, None, None, None), (None, "http://x.y/", "plain", None, None), (1, "http://a.b/c", HTML, None, None)], PAGES)
    responses = W.responses_from_pages(pages)
    source = {r.record_id: r for r in responses.collect()}
    assert len(source) == 3  # rows that repeat have one identifier
    rows = W.derivatives(responses).collect()
    assert len(rows) == 8
    for r in rows:
        own = source[r.refers_to]
        payload = bytes(own.block).partition(b"\r\n\r\n")[2]
        assert (r.page_id, r.target_uri, r.warc_date) == (own.page_id, own.target_uri, own.warc_date)
        assert r.source_block_digest == digest(own.block) and r.source_payload_digest == digest(payload)
        assert r.block_digest == digest(r.block.encode()) and r.content_length == len(r.block.encode())
        assert r.source_headers == f"Content-Type: text/html; charset=utf-8\nContent-Length: {len(payload)}"
    text = {(r.page_id, r.warc_type): r for r in rows}
    assert text[1, "conversion"].block == "Über\none two"
    assert text[2, "conversion"].block == "" and text[None, "conversion"].block == "plain"
    meta = text[1, "metadata"].block
    assert "title: A &amp; B\r\n" in meta and "http-status: HTTP/1.1 200 OK\r\n" in meta and f"conversion-id: <{text[1, 'conversion'].record_id}>" in meta


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", HTML * (i + 1), None, None) for i in range(20)], PAGES)
    responses = W.responses_from_pages(pages).orderBy("page_id")
    members = b"".join(W.to_member([("WARC-Type", "response"), ("WARC-Record-ID", f"<{r.record_id}>"), ("WARC-Target-URI", r.target_uri), ("WARC-Date", r.warc_date), ("Content-Length", str(len(r.block)))], bytes(r.block)) for r in responses.collect())
    (tmp_path / "a.warc.gz").write_bytes(members)
    read = W.read_responses(spark, str(tmp_path))
    assert sorted(map(tuple, read.drop("page_id").collect())) == sorted(map(tuple, responses.drop("page_id").collect()))
    derived = W.derivatives(read, members=True).collect()
    for r in derived:
        (headers, block), = W.parse(bytes(r.member))
        assert headers["warc-type"] == r.warc_type and headers["warc-refers-to"] == f"<{r.refers_to}>" and block.decode() == r.block and headers["warc-block-digest"] == digest(block)


def test_odd_responses():
    kinds = {k: (h, b, s) for k, h, b, s in W.derive("urn:x", "", "d", b"no http at all \xff")}
    assert kinds["conversion"][1].decode() == "no http at all �" and kinds["conversion"][2] == ""
    latin = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nX-A: 1\r\nX-A: 2\r\n\r\n<p>caf\xe9"
    kinds = {k: (h, b, s) for k, h, b, s in W.derive("urn:x", "http://a\r\nEvil: 1", "d", latin)}
    assert kinds["conversion"][1].decode() == "café" and kinds["conversion"][2].endswith("X-A: 1\nX-A: 2")
    assert b"\r\nEvil" not in W.to_bytes(*kinds["metadata"][:2]).partition(b"\r\n\r\n")[0]
    assert [h for h, _ in W.parse(W.to_bytes(*kinds["metadata"][:2])[:-20])] == []


def test_empty_and_long(spark):
    assert W.derivatives(W.responses_from_pages(spark.createDataFrame([], PAGES))).count() == 0
    long = spark.createDataFrame([(1, "u", "<p>" + "word " * 300_000, None, None)], PAGES)
    assert W.derivatives(W.responses_from_pages(long)).where("warc_type = 'conversion'").first().content_length == 1_499_999


@pytest.mark.parametrize("name", ["undefined", "idna", "utf\x008", "no-such", "hex", "rot13", "punycode", "", "UTF-16"])
def test_odd_charsets(name):
    page = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset={name}\r\n\r\n".encode() + b"<p>caf\xc3\xa9"
    kinds = {k: b for k, _, b, _ in W.derive("urn:x", "", "d", page)}
    if name not in ("punycode", "UTF-16"):  # these are charsets
        assert kinds["conversion"].decode() == "café" and b"charset: utf-8\r\n" in kinds["metadata"]
    meta = b"HTTP/1.1 200 OK\r\n\r\n<meta charset='undefined'><p>x"
    assert {k: b for k, _, b, _ in W.derive("urn:x", "", "d", meta)}["conversion"] == b"x"


def record(kind, block, length=None):
    return W.to_bytes([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{kind}:{len(block)}>"), ("Content-Length", str(len(block) if length is None else length))], block)


def test_files_are_read_record_by_record(spark, tmp_path):
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n\x00\xff" + bytes([i]) * 5000 * i for i in range(12)]
    inner = b"HTTP/1.1 200 OK\r\n\r\nx" + W.BETWEEN + record("response", b"within") + W.BETWEEN + b"WARC/ no record"
    data = record("warcinfo", b"i") + b"".join(record("response", b) for b in blocks) + record("response", b"cut short", 10**6) + record("response", inner) + record("request", b"q") + record("response", b"last")[:-4]
    want = sorted([*blocks, inner, b"last"])
    (tmp_path / "a.warc").write_bytes(data)
    assert sorted(bytes(r.block) for r in W.read_responses(spark, str(tmp_path / "a.warc")).collect()) == want
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data[:50_000]) + gzip.compress(data[50_000:]))
    assert sorted(bytes(r.block) for r in W.read_responses(spark, str(tmp_path / "b.warc.gz")).collect()) == want
    (tmp_path / "c.warc").write_bytes(b"")
    assert W.read_responses(spark, str(tmp_path / "c.warc")).count() == 0
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        split = W.read_responses(spark, str(tmp_path / "a.warc"))
        assert split.rdd.getNumPartitions() > 4 and set(blocks) <= {bytes(r.block) for r in split.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_query_equals_plain_python(spark):
    """All of the smallest table, links, digests and bodies, against a plain loop over its rows."""
    sf = "/root/testdata/sf0.001"
    got = {(r.page_id, r.warc_type): r for r in W.op2_warc_derivatives(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == 2 * len(pages)
    for p in pages:
        payload = (p.html or "").encode()
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
        meta, text = got[p.page_id, "metadata"], got[p.page_id, "conversion"]
        source = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(['response', str(p.page_id), p.url or '', digest(payload)]))}"
        for r in (meta, text):
            assert (r.refers_to, r.target_uri, r.source_block_digest, r.source_payload_digest) == (source, p.url or "", digest(block), digest(payload))
            assert r.record_id == f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, r.warc_type + chr(10) + source)}"
            assert r.block_digest == digest(r.block.encode()) and r.content_length == len(r.block.encode())
        bare = re.sub(r"(?is)<(script|style|title|textarea|noscript|svg|iframe|template)\b.*?</\1\s*>|<!--.*?-->", " ", p.html or "")
        words = html.unescape(re.sub(r"(?s)<[^>]*>", " ", bare)).split()
        assert text.block.replace(" ", "").replace("\n", "") == "".join(words)
        assert f"text-length: {len(text.block)}\r\n" in meta.block and f"conversion-id: <{text.record_id}>" in meta.block


def test_charset_is_seen_wherever_the_head_ends():
    far = b"<html><head>" + b"<!-- " + b"x" * 5000 + b" --><meta charset='latin-1'></head><body>caf\xe9 charset=ascii</body>"
    assert W.decoded([], far) == ("latin-1", far.decode("latin-1"))
    assert W.decoded([], b"<body>charset=latin-1 \xc3\xa9")[0] == "utf-8"
