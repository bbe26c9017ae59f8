"""WARC derivatives: responses become linked metadata and conversion records.

A response record (an HTTP message) gives two records. `metadata` (application/warc-fields) holds the status, the source's
HTTP headers as they came, its digests, the title, language, character set and links. `conversion` (text/plain) holds the
text. Both name the response in WARC-Refers-To, with its target URI and date, and each other in WARC-Concurrent-To; both
carry the source's payload digest. Identifiers are UUIDs (version 5) of their source, so a task that runs again gives the
same ones. The work is one row at a time in one scan; nothing is shuffled.

Nulls: a null URL leaves out the target URI; a null page is an empty body and gives an empty text. A null page_id stays
null. Repeated rows give equal records. An empty table gives an empty one. A page of any length is read in time that goes
with its length, and lies whole in a task's memory, as does a WARC file. Other columns, whatever their names, are not read. A response whose HTTP head or declared length is broken
is taken as far as it goes: what has no head is a body without headers. Chunks and the codings gzip and deflate are undone
before the text is read; a body that does not begin as its headers say, or has another coding (br, zstd), stays as it is.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._session import frugal

VERSION = b"WARC/1.1"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
#: Fixed date of responses made from a table that has none.
DATE = "2000-01-01T00:00:00Z"
RECORDS = "page_id long, record_type string, record_id string, refers_to string, target_uri string, content_type string, content_length long, block_digest string, source_digest string, record binary"

HIDDEN = re.compile(r"(?i)<!--|<(script|style|noscript|template|head|svg|textarea)\b[^>]*>")
BREAK = re.compile(r"(?i)</?(?:p|div|br|hr|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|aside|blockquote|pre|dl|dt|dd|form|main|figure|figcaption|title|body|html)\b[^>]*>")
TAG = re.compile(r"(?s)<[!/?A-Za-z][^>]*(?:>|\Z)")
TITLE = re.compile(r"(?i)<title\b[^>]*>")
OPENED = {name: re.compile(rf"(?i)<{name}\b") for name in ("html", "a")}
LANG = re.compile(r"(?i)\blang\s*=\s*[\"']?([A-Za-z-]+)")
HREF = re.compile(r"(?i)\bhref\s*=\s*")
VALUE = re.compile(r"\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)")
CHARSET = re.compile(rb"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)")
GAP = re.compile(r"[^\S\n]+")
LINES = re.compile(r"\s*\n\s*")
CHUNK = re.compile(rb"[ \t]*([0-9A-Fa-f]{1,15})[ \t]*(?:;[^\r\n]*)?\r\n")


@dataclass
class Record:
    headers: list[tuple[str, str]] = field(default_factory=list)
    block: bytes = b""

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self) -> bytes:
        head = b"".join(f"{k}: {v}\r\n".encode() for k, v in self.headers)
        return VERSION + b"\r\n" + head + b"\r\n" + self.block + b"\r\n\r\n"


def read_records(data: bytes) -> Iterator[Record]:
    """Records of a WARC file, plain or of gzip members; a file that is cut off or broken as far as it goes."""
    if data[:2] == b"\x1f\x8b":
        data = inflated(data, "gzip")
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        headers: list[tuple[str, str]] = []
        for line in data[at:end].split(b"\r\n")[1:]:
            if line[:1] in b" \t" and headers and line:
                headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.decode('utf-8', 'replace').strip()}")
            elif b":" in line:
                k, v = line.decode("utf-8", "replace").split(":", 1)
                headers.append((k.strip(), v.strip()))
        record = Record(headers)
        length = record.get("Content-Length") or ""
        size = int(length) if length.isdigit() else 0
        record.block = data[end + 4 : end + 4 + size]
        yield record
        at = end + 4 + size


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def identifier(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join('' if p is None else str(p) for p in parts))}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def response(uri: str | None, body: bytes, key: object = None, date: str = DATE, headers: Iterable[tuple[str, str]] = (("Content-Type", "text/html; charset=utf-8"),)) -> Record:
    """A response record around a body."""
    head = "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(body)}\r\n\r\n"
    block = head.encode() + body
    payload = digest(body)
    out = [("WARC-Type", "response"), ("WARC-Record-ID", identifier("response", key, uri, payload)), ("WARC-Date", date)]
    if uri is not None:
        out.append(("WARC-Target-URI", one_line(uri)))
    out += [("WARC-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return Record(out, block)


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and body of an HTTP message."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        return "", [], block
    lines = head.decode("latin-1").split("\r\n")
    return lines[0], [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines[1:]) if _], body


def codings(headers: list[tuple[str, str]], name: str) -> list[str]:
    return [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",") if x.strip()]


def dechunked(body: bytes) -> bytes:
    """The chunks' content, as far as it goes; the body itself where it does not begin with a chunk."""
    out, at = [], 0
    while m := CHUNK.match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
    return b"".join(out) if out else body


def inflated(body: bytes, coding: str) -> bytes:
    """gzip's members or deflate, with or without zlib's head, as far as it goes; the body itself where it is neither."""
    for bits in (31,) if coding != "deflate" else (15, -15):
        out, left, ended = [], body, False
        try:
            while left:
                step = zlib.decompressobj(bits)
                for at in range(0, len(left), 1 << 16):
                    out.append(step.decompress(left[at : at + (1 << 16)]))
                    if step.eof:
                        break
                ended = ended or step.eof
                left = step.unused_data + left[at + (1 << 16) :] if step.eof and coding != "deflate" else b""
        except zlib.error:
            pass
        if ended or any(out):
            return b"".join(out)
    return body


def decoded(body: bytes, headers: list[tuple[str, str]]) -> tuple[str, str]:
    """The body's text and its character set: of the headers, else of the first 2048 bytes' markup, else UTF-8."""
    kind = next((v for k, v in headers if k.lower() == "content-type"), "").encode("latin-1", "replace")
    m = CHARSET.search(kind) or CHARSET.search(body[:2048])
    name = m[1].decode("ascii") if m else "utf-8"
    try:
        return body.decode(name, "replace"), name.lower()
    except LookupError:
        return body.decode("utf-8", "replace"), "utf-8"


def closing(name: str) -> re.Pattern:
    return re.compile(rf"(?i)</{name}\s*>")


def reach(markup: str) -> int:
    """Behind the last >: what begins later is never closed. Patterns that end in > are only sought up to there, so that
    none of them runs to the end in vain for each of many openings."""
    return markup.rfind(">") + 1


def shown(markup: str) -> str:
    """A blank for each comment and hidden element; one that is not closed goes on to the end."""
    out, at, last = [], 0, reach(markup)
    while m := HIDDEN.search(markup, at, last):
        out.append(markup[at : m.start()])
        end = closing(m[1].lower()).search(markup, m.end()) if m[1] else re.compile("-->").search(markup, m.end())
        if end is None:
            return " ".join([*out, ""])
        at = end.end()
    return " ".join([*out, markup[at:]])


def tags(markup: str, name: str) -> Iterator[tuple[int, int]]:
    """Where what stands in each tag begins and ends; one that is not closed goes on to the end."""
    at = 0
    while m := OPENED[name].search(markup, at):
        at = markup.find(">", m.end())
        at = len(markup) if at < 0 else at
        yield m.end(), at


def title_of(markup: str) -> str:
    if not (m := TITLE.search(markup, 0, reach(markup))):
        return ""
    end = closing("title").search(markup, m.end())
    return one_line(html.unescape(TAG.sub("", markup[m.end() : end.start() if end else len(markup)])))


def language_of(markup: str) -> str:
    """The last lang of the first html tag that has one."""
    return next((found[-1].lower() for begin, end in tags(markup, "html") if (found := LANG.findall(markup, begin, end))), "")


def links_of(markup: str) -> list[str]:
    """The first href of each a tag; a tag not closed may hold others, each with its own."""
    out = []
    for begin, end in tags(markup, "a"):
        while begin < end:
            value = None
            for m in HREF.finditer(markup, begin, end):
                if value := VALUE.match(markup, m.end()):
                    break
            if value is None:
                break
            out.append(one_line(html.unescape(next(x for x in value.groups() if x is not None))))
            other = OPENED["a"].search(markup, value.end(), end) if value.end() < end else None
            begin = other.end() if other else end
    return out


def plain_text(markup: str) -> str:
    """Visible text, a line for each block, characters of entities in place."""
    text = shown(markup.replace("\r", "").replace("\n", " "))
    last = reach(text)
    text = TAG.sub("", BREAK.sub("\n", text[:last]) + text[last:])
    return LINES.sub("\n", GAP.sub(" ", html.unescape(text))).strip()


def derive(source: Record) -> list[Record]:
    """metadata and conversion of a response record; nothing for other records."""
    if (source.get("WARC-Type") or "").lower() != "response":
        return []
    status, headers, body = http_parts(source.block)
    transfer = codings(headers, "transfer-encoding")
    if "chunked" in transfer:
        body = dechunked(body)
    plain = body
    for coding in reversed([*codings(headers, "content-encoding"), *(x for x in transfer if x != "chunked")]):
        plain = inflated(plain, coding) if coding in ("gzip", "x-gzip", "deflate") else plain
    markup, charset = decoded(plain, headers)
    ref = source.get("WARC-Record-ID") or identifier("unnamed", hashlib.sha256(source.block).hexdigest())
    payload = source.get("WARC-Payload-Digest") or digest(body)
    ids = {kind: identifier(kind, ref) for kind in ("metadata", "conversion")}
    fields = [("http-status", status), *(("http-header", f"{k}: {v}") for k, v in headers), ("source-payload-digest", payload)]
    if source.get("WARC-Block-Digest"):
        fields.append(("source-block-digest", source.get("WARC-Block-Digest")))
    fields += [("charset", charset), ("title", title_of(markup)), ("language", language_of(markup))]
    fields += [("outlink", x) for x in links_of(markup)]
    blocks = {
        "metadata": ("application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "replace")),
        "conversion": ("text/plain; charset=utf-8", plain_text(markup).encode("utf-8", "replace")),
    }
    out = []
    for kind, (content, block) in blocks.items():
        other = ids["conversion" if kind == "metadata" else "metadata"]
        head = [("WARC-Type", kind), ("WARC-Record-ID", ids[kind]), ("WARC-Date", source.get("WARC-Date") or DATE), ("WARC-Refers-To", ref), ("WARC-Concurrent-To", other)]
        if (uri := source.get("WARC-Target-URI")) is not None:
            head += [("WARC-Target-URI", uri), ("WARC-Refers-To-Target-URI", uri)]
        head += [("WARC-Refers-To-Date", source.get("WARC-Date") or DATE), ("WARC-Source-Payload-Digest", payload), ("WARC-Block-Digest", digest(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
        out.append(Record(head, block))
    return out


def _rows(key, source: Record) -> list[tuple]:
    return [(key, r.get("WARC-Type"), r.get("WARC-Record-ID"), r.get("WARC-Refers-To"), r.get("WARC-Target-URI"), r.get("Content-Type"), len(r.block), r.get("WARC-Block-Digest"), r.get("WARC-Source-Payload-Digest"), r.to_bytes()) for r in derive(source)]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), pa.string(), pa.binary())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])


def derivatives(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html, ...) -> two rows for each: the derived records and what their headers say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for key, uri, page in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    rows += _rows(key, response(uri, (page or "").encode("utf-8", "surrogatepass"), key))
                yield _table(rows)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(frugal(run), RECORDS)


def derivatives_of_files(spark, path: str) -> DataFrame:
    """The same from WARC files, one file a task; page_id is the record's place in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for place, source in enumerate(read_records(content.as_py())):
                    if rows := _rows(place, source):
                        yield _table(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(frugal(run), RECORDS)


def query(spark, sf_dir: str) -> DataFrame:
    return derivatives(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("record_sha256", F.sha2("record", 256)).drop("record")
