"""WARC derivatives: responses become linked metadata and plain-text conversion records."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from driftcurve.llm.html_extract import RAW, blocks_of
from driftcurve.session import with_code

VERSION = "WARC/1.1"
#: What `pages` does not say about a fetch.
UNKNOWN_DATE = "1970-01-01T00:00:00Z"
STATUS_LINE = "HTTP/1.1 200 OK"

Header = list[tuple[str, str]]


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An identifier that depends on what it names alone, so a repeated task writes the same one."""
    return uuid.uuid5(uuid.NAMESPACE_URL, "\n".join(parts)).urn


def one_line(value: str) -> str:
    """A header's value may not break its line."""
    return " ".join(value.split())


# --- records as bytes -----------------------------------------------------------------------------


def to_bytes(headers: Header, block: bytes) -> bytes:
    head = "".join(f"{k}: {one_line(v)}\r\n" for k, v in headers)
    return f"{VERSION}\r\n{head}\r\n".encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def to_member(headers: Header, block: bytes) -> bytes:
    """A record as a gzip member; members one after another are a .warc.gz file."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as z:
        z.write(to_bytes(headers, block))
    return out.getvalue()


def headers_of(data: bytes, end: int) -> dict[str, str]:
    """A record's headers by lower-case name; `end` is where its blank line starts."""
    headers: dict[str, str] = {}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    return headers


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a .warc or .warc.gz file's bytes: headers by lower-case name, and the block. A cut last record ends it."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers = headers_of(data[at:], end - at)
        length = headers.get("content-length", "")
        if not length.isdigit() or end + 4 + int(length) > len(data):
            return
        at = end + 4 + int(length)
        yield headers, data[end + 4 : at]


#: What stands between two records, and how the later one starts.
BETWEEN, START = b"\r\n\r\n", b"WARC/"


def joined(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a file that was cut wherever a record may start.

    A block that holds such a place is put together again until it is as long as its header says. If that
    never comes out even, the record itself was cut short: it is left out and reading goes on behind it.
    At most the stated length of one record is held.
    """
    source, again = iter(pieces), deque()
    waiting: list[bytes] = []
    size = need = 0
    while True:
        piece = again.popleft() if again else next(source, None)
        if piece is None and not waiting:
            return
        if piece is not None:
            piece = piece if waiting or piece.startswith(START) else START + piece
            if not waiting:
                end = piece.find(b"\r\n\r\n")
                length = headers_of(piece, end).get("content-length", "") if end >= 0 else ""
                if not length.isdigit():
                    continue
                size, need = -len(BETWEEN + START), end + 4 + int(length)
            waiting.append(piece)
            size += len(BETWEEN + START) + len(piece)
            if size < need:
                continue
            data = (BETWEEN + START).join(waiting)
            if not data[need:].strip():
                end = data.find(b"\r\n\r\n")
                yield headers_of(data, end), data[end + 4 : need]
                waiting = []
                continue
        again.extendleft(reversed(waiting[1:]))
        waiting = []


def split_http(block: bytes) -> tuple[str, Header, bytes]:
    """A response's status line, headers in order, and payload. A block without a header's end is all payload."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = head.decode("latin-1").split("\r\n")
    pairs = [(k.strip(), v.strip()) for k, c, v in (x.partition(":") for x in lines) if c]
    return status, pairs, payload


def head_of(payload: bytes) -> bytes:
    """What lies before the body of a page; all of it where none begins."""
    at = payload.lower().find(b"<body")
    return payload if at < 0 else payload[:at]


def named_charset(headers: Header, payload: bytes) -> str:
    """The encoding that the content type names, or else a meta element; else UTF-8."""
    for text in (next((v for k, v in headers if k.lower() == "content-type"), ""), head_of(payload).decode("latin-1")):
        at = text.lower().find("charset=")
        if at >= 0 and (name := text[at + 8 :].strip(" \"'").split(";")[0].split('"')[0].split("'")[0].split(">")[0].strip(" /")):
            return name.lower()
    return "utf-8"


def decoded(headers: Header, payload: bytes) -> tuple[str, str]:
    """The charset that a payload is read in and its text. A name that no codec of texts has, or whose codec cannot replace what it cannot read, counts as UTF-8."""
    name = named_charset(headers, payload)
    try:
        return name, payload.decode(name, "replace")
    except (LookupError, ValueError):  # UnicodeError is a ValueError, and so is a NUL in a name
        return "utf-8", payload.decode("utf-8", "replace")


# --- responses ------------------------------------------------------------------------------------

RESPONSE = "page_id bigint, record_id string, target_uri string, warc_date string, block binary"


def responses_from_pages(pages: DataFrame, date: str = UNKNOWN_DATE) -> DataFrame:
    """Response records for `pages`: an HTTP response around each html, in UTF-8.

    Defined cases: null urls and htmls count as empty; a null page_id stays null; rows that repeat give
    equal records; an empty table gives none; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                page, url, html = (b.column(j)[i].as_py() for j in range(3))
                payload = (html or "").encode("utf-8", "surrogatepass")
                head = f"{STATUS_LINE}\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                rows.append((page, record_id("response", str(page), url or "", sha1(payload)), url or "", date, head.encode() + payload))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["page_id", "record_id", "target_uri", "warc_date", "block"])

    return with_code(pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))).mapInArrow(run, RESPONSE)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of .warc and .warc.gz files at any of Spark's paths; `page_id` is a hash of the record's identifier.

    Spark's line reader cuts the files at the places where a record may start, so a task holds one record
    at a time and large plain files are shared by many tasks; gzip files are read from start to end, member
    by member. Identifiers and targets that a record lacks are empty, its date is UNKNOWN_DATE; other
    types of records and what is no record are left out, and so is a record that was cut short. A
    block that itself holds the start of a record is put together again where its parts lie in one split of
    the file (always, in gzip files). An empty file, or none, gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, bytes]]:
            for b in batches:
                for i in range(b.num_rows):
                    yield b.column(0)[i].as_py(), b.column(1)[i].as_py()

        for _, own in groupby(rows(), key=itemgetter(0)):
            for h, block in joined(x for _, x in own):
                if h.get("warc-type") == "response":
                    cells = (h.get("warc-record-id", "").strip("<>"), h.get("warc-target-uri", ""), h.get("warc-date", UNKNOWN_DATE), block)
                    kinds = (pa.string(), pa.string(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, kinds, strict=True)], names=["record_id", "target_uri", "warc_date", "block"])

    cut = spark.read.option("lineSep", (BETWEEN + START).decode()).text(path).select("_metadata.file_path", F.col("value").cast("binary").alias("value"))
    found = with_code(cut).mapInArrow(run, RESPONSE.removeprefix("page_id bigint, "))
    return found.select(F.xxhash64("record_id").alias("page_id"), "record_id", "target_uri", "warc_date", "block")


# --- derivatives ----------------------------------------------------------------------------------


def plain_text(page: str) -> tuple[str, str]:
    """The title and the visible text of an HTML page, one line a block."""
    title = ""
    low = page.lower()
    if (a := low.find("<title")) >= 0 and (b := low.find(">", a)) >= 0 and (c := low.find("</title", b)) >= 0:
        title = page[b + 1 : c]
    lines = [t for p, t, _ in blocks_of(page) if t and p.rpartition("/")[2] not in RAW]
    return one_line(title), "\n".join(lines)


def derive(identifier: str, uri: str, date: str, block: bytes) -> list[tuple[str, Header, bytes, str]]:
    """The metadata and the conversion record of one response: type, headers, block, and the source's headers.

    Both refer to the response by WARC-Refers-To, keep its target and date, and carry the digests of its
    block and payload; each has its own digest and an identifier that follows from the response's. The
    metadata block repeats the response's HTTP status and headers.
    """
    status, http, payload = split_http(block)
    charset, page = decoded(http, payload)
    title, text = plain_text(page)
    source = "\n".join(f"{k}: {one_line(v)}" for k, v in http)
    ids = {kind: record_id(kind, identifier) for kind in ("metadata", "conversion")}
    digests = sha1(block), sha1(payload)
    fields = [
        ("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in http), ("charset", charset), ("title", title), ("source-block-digest", digests[0]), ("source-payload-digest", digests[1]),
        ("source-content-length", str(len(block))), ("text-length", str(len(text))), ("conversion-id", f"<{ids['conversion']}>"),
    ]
    meta = "".join(f"{k}: {one_line(v)}\r\n" for k, v in fields).encode("utf-8", "surrogatepass")
    out = []
    for kind, content, body in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass"))):
        headers = [
            ("WARC-Type", kind), ("WARC-Record-ID", f"<{ids[kind]}>"), ("WARC-Refers-To", f"<{identifier}>"), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", uri), ("WARC-Date", date),
            ("WARC-Source-Block-Digest", digests[0]), ("WARC-Source-Payload-Digest", digests[1]), ("WARC-Block-Digest", sha1(body)), ("Content-Type", content), ("Content-Length", str(len(body))),
        ]
        out.append((kind, [(k, v) for k, v in headers if v], body, source))
    return out


DERIVED = "page_id bigint, warc_type string, record_id string, refers_to string, target_uri string, warc_date string, content_type string, content_length bigint, block_digest string, source_block_digest string, source_payload_digest string, source_headers string, block string"


def derivatives(responses: DataFrame, members: bool = False) -> DataFrame:
    """Two rows per response: its metadata and its conversion record, as columns; with `members` also as gzip members.

    Defined cases: a null block counts as empty, a null identifier as the empty one; a block that is no
    HTTP response is all payload, without source headers; text that is not valid in its charset gets
    replacement characters; rows that repeat give equal records; an empty table gives none; other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
                rows = []
                for i in range(b.num_rows):
                    page, identifier, uri, date, block = (b.column(j)[i].as_py() for j in range(5))
                    for kind, headers, body, source in derive(identifier or "", uri or "", date or UNKNOWN_DATE, block or b""):
                        h = dict(headers)
                        row = [page, kind, h["WARC-Record-ID"].strip("<>"), h["WARC-Refers-To"].strip("<>"), uri, h["WARC-Date"], h["Content-Type"], len(body), h["WARC-Block-Digest"], h["WARC-Source-Block-Digest"], h["WARC-Source-Payload-Digest"], source, body.decode("utf-8", "surrogatepass")]
                        rows.append([*row, to_member(headers, body)] if members else row)
                kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 5, *[pa.binary()] * members]
                names = [x.split()[0] for x in DERIVED.split(", ")] + ["member"] * members
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    columns = responses.select(F.col("page_id").cast("bigint"), "record_id", "target_uri", "warc_date", "block")
    return with_code(columns).mapInArrow(run, DERIVED + (", member binary" if members else ""))


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all of `pages`."""
    return derivatives(responses_from_pages(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")))
