import base64
import gzip
import hashlib
from html.parser import HTMLParser

from tessera.llm import warc as w


class Plain(HTMLParser):
    """What is visible, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head", "noscript", "template", "svg", "textarea"):
            self.hidden.append(tag)
        self.out.append(" " if tag not in ("b", "i", "a", "em", "span") else "")

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        self.out.append(" " if tag not in ("b", "i", "a", "em", "span") else "")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def test_pages(spark):
    path = "/root/testdata/sf0.01/pages.parquet"
    pages = {r.page_id: r for r in spark.read.parquet(path).collect()}
    rows = w.derivatives(spark.read.parquet(path)).collect()
    assert len(rows) == 2 * len(pages)
    by = {(r.page_id, r.record_type): r for r in rows}
    for k, p in pages.items():
        meta, text = by[k, "metadata"], by[k, "conversion"]
        source = w.response(p.url, p.html.encode(), k)
        payload = "sha1:" + base64.b32encode(hashlib.sha1(p.html.encode()).digest()).decode()
        for r, other in ((meta, text), (text, meta)):
            (record,) = w.read_records(bytes(r.record))
            assert r.refers_to == source.get("WARC-Record-ID") and r.target_uri == p.url and r.source_digest == payload
            assert record.get("WARC-Concurrent-To") == other.record_id and record.to_bytes() == bytes(r.record)
            assert r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(record.block).digest()).decode()
        (record,) = w.read_records(bytes(meta.record))
        assert b"http-header: Content-Type: text/html; charset=utf-8\r\n" in record.block and payload.encode() in record.block
        (record,) = w.read_records(bytes(text.record))
        parser = Plain()
        parser.feed(p.html)
        parser.close()
        assert record.block.decode().split() == "".join(parser.out).split()
    assert len({r.record_id for r in rows}) == len(rows)


def test_files_round_trip(spark, tmp_path):
    sources = [w.response(f"http://a/{i}", f"<html lang=de><title>T &amp; {i}</title><p>x{i}<br>é".encode(), i) for i in range(5)]
    sources.append(w.Record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("Content-Length", "4")], b"body"))
    sources.append(w.Record([("WARC-Type", "request"), ("Content-Length", "0")]))
    (tmp_path / "a.warc").write_bytes(b"".join(s.to_bytes() for s in sources[:3]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(s.to_bytes()) for s in sources[3:]))
    rows = w.derivatives_of_files(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.record) for r in rows) == sorted(d.to_bytes() for s in sources for d in w.derive(s))
    assert any(b"title: T & 3\r\nlanguage: de\r\n" in bytes(r.record) for r in rows)


def test_odd_pages(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "u\nv", "", 2), (1, "u\nv", "", 3), (2, "x", "<p>a<script>no", 4)], "page_id int, url string, html string, record int")
    rows = w.derivatives(df).collect()
    assert len(rows) == 8 and [r.target_uri for r in rows][:3] == [None, None, "u v"]
    assert bytes(rows[7].record).endswith(b"\r\n\r\na\r\n\r\n") and w.derivatives(df.limit(0)).count() == 0


def test_chunks_and_codings_are_undone():
    import zlib

    page = b"<title>T\xc3\xa9</title><p>text</p><a href='x'>y</a>" * 3
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(page) + raw.flush()
    chunked = lambda b: b"".join(b"%x;e=1\r\n%s\r\n" % (len(b[i : i + 9]), b[i : i + 9]) for i in range(0, len(b), 9)) + b"0\r\nTrailer: 1\r\n\r\n"
    want = w.plain_text(page.decode())
    cases = [
        ((), page),
        ((("Content-Encoding", "gzip"),), gzip.compress(page)),
        ((("Content-Encoding", "x-gzip"),), gzip.compress(page[:60]) + gzip.compress(page[60:])),
        ((("Content-Encoding", "deflate"),), zlib.compress(page)),
        ((("Content-Encoding", "deflate"),), raw),
        ((("Transfer-Encoding", "chunked"),), chunked(page)),
        ((("transfer-encoding", "gzip, chunked"),), chunked(gzip.compress(page))),
        ((("Content-Encoding", "deflate, gzip"), ("Transfer-Encoding", "chunked")), chunked(gzip.compress(zlib.compress(page)))),
        ((("Content-Encoding", "gzip"), ("Transfer-Encoding", "chunked")), page),
    ]
    for headers, body in cases:
        meta, text = w.derive(w.response("http://a/", body, headers=headers))
        assert text.block.decode() == want, headers
        assert b"title: T\xc3\xa9" in meta.block and meta.block.count(b"outlink: x") == 3, headers
    _, cut = w.derive(w.response(None, gzip.compress(page)[:-9], headers=[("Content-Encoding", "gzip")]))
    assert b"text" in cut.block
    assert w.inflated(gzip.compress(b""), "gzip") == b"" and w.dechunked(b"0\r\n\r\n") == b""


def test_records_cut_off(spark, tmp_path):
    sources = [w.response(f"http://a/{i}", f"<p>page {i}".encode() * 300, i) for i in range(4)]
    whole = b"".join(gzip.compress(s.to_bytes()) for s in sources)
    assert [r.to_bytes() for r in w.read_records(whole)] == [s.to_bytes() for s in sources]
    cut = list(w.read_records(whole[:-20]))
    assert [r.to_bytes() for r in cut[:3]] == [s.to_bytes() for s in sources[:3]]
    (tmp_path / "a.warc.gz").write_bytes(whole[:-20])
    assert w.derivatives_of_files(spark, str(tmp_path)).count() >= 6


def test_long_pages_take_time_in_proportion(spark):
    import time

    parts = ("<a x ", "<html ", "<title ", "<script ", "<p ", "<!-- ", "</script ", "<a href='", "<a href=\"", " lang ", "href = ", "     ", "\n \n", "<svg><a href=1>", "&amp", "charset=", "<html lang=")
    for part in parts:
        page = part * (2_000_000 // len(part))
        began = time.process_time()
        w.derive(w.response("http://a/", page.encode()))
        assert time.process_time() - began < 10, part
    df = spark.createDataFrame([(1, "u" * 1_000_000, "<p>x</p>" * 400_000, "y")], "page_id int, url string, html string, record_type string")
    assert w.derivatives(df.selectExpr("*", "'z' as record", "'z' as record_id")).count() == 2


def test_tags_that_are_not_closed():
    def fields(page):
        return [x for x in w.derive(w.response(None, page.encode()))[0].block.decode().split("\r\n") if x.startswith(("title", "language", "outlink"))]

    assert fields("<html xml:lang=de lang='fr'><title>a<b>c</title><a x href=1 y><a class=b><a href='2>3'>") == ["title: ac", "language: fr", "outlink: 1", "outlink: 2>3"]
    assert fields("<html x><html lang=en><a href=1 <a b <a href=2") == ["title: ", "language: en", "outlink: 1", "outlink: 2"]
    text = lambda page: w.derive(w.response(None, page.encode()))[1].block.decode()
    assert text("a<!-- b --> c <script>d</SCRIPT >e<style>f") == "a c e"
    assert text("a<p>b<p c <div") == "a\nb" and text("x <3 y > z <script") == "x <3 y > z" and text("a<!-- b") == "a"
