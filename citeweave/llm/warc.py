"""Operator 7, a WARC derivative builder: responses in, metadata and conversion records out.

Each page is a response record: its HTTP headers and body make the block, its id is a UUID made from URL and page id.
For each response, a `conversion` record holds the plain text of the page, and a `metadata` record says what the source
was: its headers, title, links and digests. Both name the response in WARC-Refers-To and share its target URI and date,
and each has block and payload digests of its own (SHA-1 in base 32, as is usual in WARC files).

Nulls: a page without HTML has an empty body and text; a null URL is an empty target; a null page id stays. Repeated
pages make repeated records, with equal ids. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: All records of a build carry this date unless the caller gives another; a build is then the same each time.
DATE = "2024-01-01T00:00:00Z"
_DROP = re.compile(r"<!--.*?-->|<(script|style|noscript|template|svg)\b.*?</\1\s*>|<!\[CDATA\[.*?\]\]>|<!doctype[^>]*>", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav|title|blockquote|pre|td|th|hr|main|aside|dd|dt|dl|form|body|html|head|option)\b[^>]*>", re.I)
_TAG, _TITLE, _LINK = re.compile(r"<[^>]*>"), re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I), re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([\w-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def plain_text(page: str) -> str:
    """Text of a page, a line for each block."""
    text = entities.unescape(_TAG.sub("", _BREAK.sub("\n", _DROP.sub(" ", page))))
    lines = (" ".join(x.split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def _tidy(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value)


def record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes, content_type: str) -> bytes:
    """One WARC/1.1 record without its final empty line's last line end, which a line-wise writer adds."""
    head = [("WARC-Type", kind), ("WARC-Record-ID", rid), *headers, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {_tidy(v)}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n"


_OUT = ["page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "source_headers", "source_block_digest", "source_payload_digest", "block_digest", "content_type", "content_length", "payload", "record"]


def derive(page_id: object, url: str | None, page: str | None, date: str = DATE) -> list[tuple]:
    body, url = (page or "").encode("utf-8", "replace"), url or ""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n"
    source = record_id("response", page_id, url)
    block_digest, payload_digest = digest(http.encode() + body), digest(body)
    linked = [("WARC-Refers-To", source), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", url), ("WARC-Date", date)]
    text = plain_text(page or "")
    title = _TITLE.search(page or "")
    language = _LANG.search(page or "")
    links = []
    for m in _LINK.finditer(_DROP.sub(" ", page or "")):
        try:
            links.append(urljoin(url, entities.unescape(next(x for x in m.groups() if x is not None)).strip()))
        except ValueError:
            pass
    about = [("source-status", http.split("\r\n")[0]), *((f"source-{x.split(': ')[0].lower()}", x.split(": ")[1]) for x in http.split("\r\n")[1:] if x), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("title", plain_text(title[1]).replace("\n", " ") if title else ""), ("language", language[1] if language else ""), *(("outlink", x) for x in links)]
    fields = "".join(f"{k}: {_tidy(v)}\r\n" for k, v in about)
    rows = []
    for kind, content_type, block in (("metadata", "application/warc-fields", fields), ("conversion", "text/plain; charset=utf-8", text)):
        data = block.encode("utf-8", "replace")
        rid = record_id(kind, page_id, url)
        extra = [("WARC-Payload-Digest", digest(data))] if kind == "conversion" else []
        rows.append((page_id, kind, rid, source, url, date, http, block_digest, payload_digest, digest(data), content_type, len(data), block, record(kind, rid, [*linked, *extra], data, content_type)))
    return rows


def _derivatives(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html")]
                rows = [r for x in zip(*columns) for r in derive(*x, date)]
                kinds = [part.schema.field("page_id").type, *[pa.string()] * 10, pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_OUT)

    return run


def derivatives(pages: DataFrame, date: str = DATE) -> DataFrame:
    """A metadata and a conversion record for each page, as columns and as the bytes of the record."""
    kind = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, " + ", ".join(f"{c} string" for c in _OUT[1:11]) + ", content_length long, payload string, record binary"
    return pages.select("page_id", "url", "html").mapInArrow(_derivatives(date), schema)


def write(records: DataFrame, path: str) -> None:
    """Write records as WARC files, one for each partition."""
    records.select(F.decode("record", "UTF-8")).write.option("lineSep", "\r\n").text(path)


_START, _LENGTH = re.compile(rb"^WARC/\d", re.M), re.compile(r"\d+")


def records_of(data: bytes) -> Iterator[tuple]:
    """(record_type, record_id, refers_to, target_uri, payload) of a file's records, in order.

    Names of fields may have any case; of a field that comes twice the first counts, one that is missing is null. Bytes
    that aren't UTF-8 are replaced in a header. What stands before a record's first line is passed over. Where a length is
    missing or no number, and where no record follows on the block, the payload ends before the next line that begins as a
    record, or with the file; a block cut off by the end is as long as it is. A header without an end is no record."""
    data = gzip.decompress(data) if data.startswith(b"\x1f\x8b") else data  # records may be members of their own
    found = _START.search(data)
    while found:
        stop = data.find(b"\r\n\r\n", found.start())
        if stop < 0:
            return
        head: dict[str, str] = {}
        for line in data[found.start() : stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                head.setdefault(name.strip().lower(), value.strip())
        begin, size = stop + 4, head.get("content-length", "")
        end = begin + int(size) if _LENGTH.fullmatch(size) else len(data) + 1
        if end < len(data) and not _START.match(data, end + len(data[end : end + 4]) - len(data[end : end + 4].lstrip(b"\r\n"))) and data[end:].strip():
            end = len(data) + 1  # the length is wrong
        found = _START.search(data, min(end, len(data)) if end <= len(data) else begin)
        if end > len(data):
            end = found.start() if found else len(data)
            end -= 4 if data[begin:end].endswith(b"\r\n\r\n") else 0
        yield head.get("warc-type"), head.get("warc-record-id"), head.get("warc-refers-to"), head.get("warc-target-uri"), data[begin:end]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files: record_type, record_id, refers_to, target_uri and payload (binary), see `records_of`. A file
    is read by one task, so files should be cut at about a GB, as is usual."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                for rows in iter(lambda found=records_of(data): list(islice(found, 256)), []):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.string()] * 4 + [pa.binary()])], names=["record_type", "record_id", "refers_to", "target_uri", "payload"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "record_type string, record_id string, refers_to string, target_uri string, payload binary")
