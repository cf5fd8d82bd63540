"""WARC derivatives: from response records, linked metadata and plain-text conversion records.

A response record has the columns record_id, target_uri, warc_date, block (the HTTP response: status line, headers, empty
line, body). For each, two records are derived that name it in WARC-Refers-To and keep its target and date: a `metadata`
record of warc-fields (the source's status and headers, payload digest, title, language, out-links) and a `conversion`
record with the plain text of its HTML. Record ids are name-based, digests are SHA-1 in base32, both as WARC writes them.

Chunks and content encodings (gzip, deflate, zstd) of a body are undone and its charset is taken from the Content-Type header,
else from a meta tag, else UTF-8. The payload digest is that of the body as it was sent, without its chunks. A written
record keeps what the row has: the refers-to id, the payload digest, and each source header in a WARC-Source-Header line.

Everything works on one record at a time, in one pass without a shuffle. Defined cases: a null or empty body gives a
metadata record and a conversion record without text; a null target or date leaves that header out; a block without an
empty line is all headers; header names are kept as they come, repeated ones all; a body that its encoding does not fit is
read as it is, an unknown charset as UTF-8, wrong bytes as replacement characters. Line breaks in header values become
blanks. Equal responses give equal records (and ids), one for each row. A null record_id is named after the rest of the
response. Kept columns that have a derived column's name come out as `source_<name>`. Reading, a record without a valid
length ends at the next record. Empty table: empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import core

#: Pages carry no crawl time; a caller with one passes a column.
NO_DATE = "1970-01-01T00:00:00Z"
STEP_BYTES = 8 << 20
_GONE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|hr|h[1-6]|li|ul|ol|dl|dt|dd|table|tr|article|section|header|footer|nav|main|aside|blockquote|pre|title|form|figure|option)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-z][^>]*>", re.I)
_SPACE, _LINES = re.compile(r"[ \t\r\f\v ]+"), re.compile(r" ?\n[ \n]*")
_TITLE, _LANG = re.compile(r"<title\b[^>]*>(.*?)</title", re.S | re.I), re.compile(r"<html\b[^>]*\blang\s*=\s*[\"']?([\w-]+)", re.I)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tidemark:warc")
DERIVED = "record_id string, warc_type string, refers_to string, target_uri string, warc_date string, content_type string, source_headers array<struct<name:string,value:string>>, content_length long, block_digest string, payload_digest string, block binary"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def name(*parts: str | bytes | None) -> str:
    """A record id from what identifies the record."""
    text = hashlib.sha256(b"\0".join(b"\1" if p is None else p if isinstance(p, bytes) else p.encode("utf-8", "surrogatepass") for p in parts)).hexdigest()
    return f"<urn:uuid:{uuid.uuid5(_NAMES, text)}>"


def plain(page: str) -> str:
    """The text of an HTML page: blocks on lines of their own, runs of white space one, scripts and comments gone."""
    text = _TAG.sub("", _BREAK.sub("\n", _GONE.sub(" ", page)))
    if "&" in text:
        text = html.unescape(text)
    return _LINES.sub("\n", _SPACE.sub(" ", text)).strip()


def read_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, s, v in (x.partition(":") for x in lines[1:]) if s], body


#: Bytes that a body may decode to; one that would be larger is read as it is.
MOST_DECODED = 1 << 28
_SIZE = re.compile(rb"[0-9A-Fa-f]{1,16}(?=[ \t]*(?:;|$))")


def _unchunked(body: bytes) -> bytes:
    """A body without its chunk sizes; as it is where any does not fit: no hexadecimal digits, or a chunk that goes on past the body or has no line end.

    A body that stops between two chunks is what came before.
    """
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = _SIZE.match(body[at:end])
        if not size:
            return body
        if not (n := int(size[0], 16)):
            return b"".join(out)
        start, at = end + 2, end + 2 + n
        if at > len(body) or body[at : at + 2] not in (b"\r\n", b""):
            return body
        out.append(body[start:at])
        at += 2
    return b"".join(out) if out and at >= len(body) else body


def _unpacked(body: bytes, encoding: str) -> bytes:
    """A body without one content encoding; as it is where that does not fit, is not known, or gives over MOST_DECODED bytes."""
    import zlib

    import zstandard

    def inflated(bits: int) -> bytes:
        d = zlib.decompressobj(bits)
        out = d.decompress(body, MOST_DECODED)
        return body if d.unconsumed_tail else out

    try:
        if encoding in ("gzip", "x-gzip"):
            return inflated(47)
        if encoding == "deflate":
            try:
                return inflated(15)
            except zlib.error:
                return inflated(-15)
        if encoding == "zstd":
            out = bytearray()
            with zstandard.ZstdDecompressor().stream_reader(body) as reader:
                while part := reader.read(1 << 20):
                    out += part
                    if len(out) > MOST_DECODED:
                        return body
            return bytes(out)
    except (zlib.error, zstandard.ZstdError):
        pass
    return body


_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def entity(headers: list[tuple[str, str]], body: bytes) -> tuple[bytes, str]:
    """The payload of a response (its body without chunks) and the page it holds as text."""
    said = lambda name: [v for k, v in headers if k.lower() == name]
    if any("chunked" in v.lower() for v in said("transfer-encoding")):
        body = _unchunked(body)
    page = body
    for encoding in reversed([e.strip().lower() for v in said("content-encoding") for e in v.split(",")]):
        page = _unpacked(page, encoding)
    charset = next((m[1] for v in said("content-type") if (m := _CHARSET.search(v))), None)
    if charset is None and (m := re.search(rb"<meta\b[^>]*charset\s*=\s*[\"']?([\w.:-]+)", page[:2048], re.I)):
        charset = m[1].decode("ascii", "replace")
    try:
        return body, page.decode(charset or "utf-8", "replace")
    except LookupError:
        return body, page.decode("utf-8", "replace")


def fields(status: str, headers: list[tuple[str, str]], payload: str, page: str) -> bytes:
    """The block of a metadata record."""
    one = lambda s: _SPACE.sub(" ", html.unescape(s).replace("\n", " ")).strip()
    out = [("source-status", status), *((f"source-header-{k.lower()}", v) for k, v in headers), ("source-payload-digest", payload)]
    if m := _TITLE.search(page):
        out.append(("title", one(_TAG.sub("", m[1]))))
    if m := _LANG.search(page):
        out.append(("language", m[1]))
    out += [("outlink", f"{one(m[1] or m[2] or m[3] or '')} L a/@href") for m in _LINK.finditer(page)]
    return "".join(f"{k}: {v}\r\n" for k, v in out).encode("utf-8", "surrogatepass")


def responses(pages: DataFrame, *, date: str = NO_DATE) -> DataFrame:
    """Response records of `pages` (page_id, url, html), with page_id beside them."""
    head = F.encode(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("\r\n\r\n")), "utf-8")
    return pages.select("page_id", F.lit(None).cast("string").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), F.concat(head, F.coalesce(F.encode("html", "utf-8"), F.lit(b""))).alias("block"))


def derive(records: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """The two derived records of each response, with the columns named in `keep` before them."""
    core.ship(records.sparkSession)
    taken = {f.split(" ")[0] for f in DERIVED.replace("struct<name:string,value:string>", "x").split(", ")}
    named = []
    for c in keep or []:
        new = c
        while new.lower() in taken:
            new = f"source_{new}"
        taken.add(new.lower())
        named.append((c, new))
    keep = [new for _, new in named]
    base = records.select(*[F.col(f"`{c}`").alias(new) for c, new in named], *[F.col(c).cast("string").alias(f"__{c}") for c in ("record_id", "target_uri", "warc_date")], F.col("block").cast("binary").alias("__block"))
    schema = ", ".join([*(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in keep), DERIVED])
    names = [*keep, *(f.split(" ")[0] for f in DERIVED.replace("struct<name:string,value:string>", "x").split(", "))]
    headers_type = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    kinds = [pa.string()] * 6 + [headers_type, pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in core.steps(batches, "__block", STEP_BYTES):
            rows, source = [], []
            for k, (rid, uri, date, block) in enumerate(zip(*(piece.column(c).to_pylist() for c in ("__record_id", "__target_uri", "__warc_date", "__block")))):
                status, headers, body = read_http(block or b"")
                body, page = entity(headers, body)
                payload = digest(body)
                rid = rid or name("response", uri, date, block or b"")
                pairs = [{"name": n, "value": v} for n, v in headers]
                for kind, content_type, out in (("metadata", "application/warc-fields", fields(status, headers, payload, page)), ("conversion", "text/plain; charset=utf-8", plain(page).encode("utf-8", "surrogatepass"))):
                    rows.append((name(kind, rid, out), kind, rid, uri, date, content_type, pairs, len(out), digest(out), payload, out))
                    source.append(k)
            kept = [piece.column(c).take(pa.array(source)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(col, kind) for col, kind in zip(zip(*rows), kinds))], names=names)

    return base.mapInArrow(run, schema)


_HEADERS = (("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type"))
_SOURCE = "WARC-Source-Header"


def serialise(row: dict) -> bytes:
    """A record as WARC 1.1 writes it; source headers in lines of a name of our own, as the standard allows."""
    one = lambda v: re.sub(r"[\r\n]+", " ", str(v)).strip()
    lines = ["WARC/1.1", f"WARC-Type: {row['warc_type']}", f"WARC-Record-ID: {row['record_id']}"]
    lines += [f"{header}: {one(row[column])}" for header, column in _HEADERS if row.get(column) is not None]
    lines += [f"{_SOURCE}: {one(h['name'])}: {one(h['value'])}" for h in row.get("source_headers") or []]
    return ("\r\n".join([*lines, f"Content-Length: {len(row['block'])}"]) + "\r\n\r\n").encode("utf-8", "surrogatepass") + bytes(row["block"]) + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file (uncompressed, or gzip members)."""
    import gzip

    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while (start := data.find(b"WARC/", at)) >= 0 and (end := data.find(b"\r\n\r\n", start)) >= 0:
        lines = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in data[start:end].decode("utf-8", "replace").split("\r\n")[1:])]
        head = {k.lower(): v for k, v in lines}
        size = head.get("content-length", "")
        if size.isdigit():
            stop = end + 4 + int(size)
        else:
            stop = data.find(b"\r\n\r\nWARC/", end)
            stop = len(data) if stop < 0 else stop
        source = [{"name": n.strip(), "value": w.strip()} for k, v in lines if k == _SOURCE for n, _, w in (v.partition(":"),)]
        yield {"warc_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), **{c: head.get(h.lower()) for h, c in _HEADERS}, "source_headers": source, "block": data[end + 4 : stop]}
        at = stop


_READ = "warc_type string, record_id string, refers_to string, target_uri string, warc_date string, block_digest string, payload_digest string, content_type string, source_headers array<struct<name:string,value:string>>, block binary"
_COLUMNS = ["warc_type", "record_id", "refers_to", "target_uri", "warc_date", "block_digest", "payload_digest", "content_type", "source_headers", "block"]


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files. A file is read whole in one task (Spark's limit is 2 GB a file); its records leave in small batches."""
    core.ship(spark)
    pairs = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    kinds = {"block": pa.binary(), "source_headers": pairs}

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in _COLUMNS], names=_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("content"):
                held, size = [], 0
                for record in parse(data.as_py()):
                    held.append(record)
                    size += len(record["block"])
                    if size > STEP_BYTES:
                        yield made(held)
                        held, size = [], 0
                if held:
                    yield made(held)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, _READ)


def with_bytes(derived: DataFrame) -> DataFrame:
    """`derived` with the whole record in column `record`, ready for a file sink."""
    core.ship(derived.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.select(_COLUMNS).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([serialise(r) for r in rows], pa.binary())], names=[*b.schema.names, "record"])

    return derived.mapInArrow(run, T.StructType([*derived.schema.fields, T.StructField("record", T.BinaryType())]))


def report(pages: DataFrame) -> DataFrame:
    """page_id and both derived records of every page."""
    return derive(responses(pages), keep=["page_id"])
