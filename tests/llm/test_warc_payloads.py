"""Conversions against a plain extraction, codings of payloads, and odd tables of pages."""

import gzip
import zlib
from html.parser import HTMLParser

import pytest
import zstandard
from pyspark.sql import functions as F

from chirplake.llm import queries, warc
from chirplake.llm.util import table


class Plain(HTMLParser):
    """All characters of a page but for its head, scripts and styles."""

    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_conversions_hold_the_text_of_their_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in table(spark, sf_dir, "pages").collect()}
    got = queries.op1_warc_derivatives(spark, sf_dir).where("record_type = 'conversion'").collect()
    assert len(got) == len(pages)
    for r in got:
        plain = Plain()
        plain.feed(pages[r["page_id"]])
        headers, block = warc.read_record(bytes(r["record"]))
        assert "".join(block.decode().split()) == "".join("".join(plain.parts).split())
        assert warc.value(headers, "WARC-Source-Payload-Digest") == warc.digest(pages[r["page_id"]].encode()) == r["source_payload_digest"]
        assert warc.value(headers, "WARC-Refers-To") == r["refers_to"]


def conversion(payload, *headers):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + b"".join(h.encode() + b"\r\n" for h in headers) + b"\r\n" + payload
    made = {kind: block for kind, _, block in warc.derive(warc.write_record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], http))}
    return made["conversion"].decode()


PAGE = "<p>caf\u00e9 and more</p>".encode() * 40
WANT = "\n\n".join(["caf\u00e9 and more"] * 40)


def chunked(data, size=100):
    return b"".join(b"%x;x=y\r\n%s\r\n" % (len(data[k : k + size]), data[k : k + size]) for k in range(0, len(data), size)) + b"0\r\n\r\n"


def raw_deflate(data):
    make = zlib.compressobj(wbits=-15)
    return make.compress(data) + make.flush()


@pytest.mark.parametrize(
    ("payload", "headers"),
    [
        (gzip.compress(PAGE), ["Content-Encoding: gzip"]), (gzip.compress(PAGE[:500]) + gzip.compress(PAGE[500:]), ["Content-Encoding: x-gzip"]), (chunked(PAGE), ["Transfer-Encoding: chunked"]),
        (chunked(gzip.compress(PAGE)), ["Content-Encoding: gzip", "Transfer-Encoding: chunked"]), (chunked(gzip.compress(PAGE)), ["Transfer-Encoding: gzip, chunked"]), (zlib.compress(PAGE), ["Content-Encoding: deflate"]),
        (raw_deflate(PAGE), ["Content-Encoding: deflate"]), (zstandard.compress(PAGE), ["Content-Encoding: zstd"]), (PAGE, ["Content-Encoding: gzip", "Transfer-Encoding: chunked"]), (PAGE, ["Content-Encoding: identity"]), (b"\xef\xbb\xbf" + PAGE, []),
    ],
)
def test_codings(payload, headers):
    assert conversion(payload, *headers) == WANT


def test_payloads_that_cannot_be_unpacked():
    assert conversion(gzip.compress(PAGE)[:-12], "Content-Encoding: gzip").startswith("caf\u00e9")
    for payload, coding in ((b"\x1f\x8b nothing", "gzip"), (PAGE, "br")):
        with pytest.raises(ValueError):
            conversion(payload, f"Content-Encoding: {coding}")
    with pytest.raises(ValueError):
        warc.unpacked(gzip.compress(bytes(10_000)), [("Content-Encoding", "gzip")], 9_999)
    assert warc.unpacked(gzip.compress(bytes(10_000)), [("Content-Encoding", "gzip")], 10_000) == bytes(10_000)
    for body in (b"zz\r\n", b"5\r\nab", b"", b"ffffffffffffffffffff\r\nx", b"\r\n"):
        assert isinstance(warc.without_chunks(body), bytes)


def test_odd_tables_of_pages(spark):
    rows = [(None, None, None), (1, "http://a/", ""), (1, "http://a/", "<p>one"), (1, "http://a/", "<p>two"), (1, "http://a/", "<p>two"), (2, None, "<p>" + "long words " * 100_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("record", F.lit(1)).withColumn("error", F.lit("x"))
    got = warc.page_derivatives(pages).collect()
    assert len(got) == 2 * len(rows)
    assert len({r["record_id"] for r in got}) == 2 * (len(rows) - 1)  # rows that are alike are one record
    assert max(r["block_bytes"] for r in got if r["record_type"] == "conversion") == len("long words " * 100_000) - 1
    assert warc.page_derivatives(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        warc.build_derivatives(spark.createDataFrame([("k", bytearray(b""))], "block string, record binary"), "block", "record")


def test_charset_of_long_tags():
    page = "<html><head><meta name='viewport'>{}</head><body><p>Привет, мир</p></body>"
    long = "<meta data-long='" + "x > " * 3000 + "' charset=\"windows-1251\">"
    content = "<META http-equiv=Content-Type content='" + " " * 10_000 + "text/html; charset=windows-1251'>"
    for tag in (long, content, "<meta charset=windows-1251>"):
        assert warc.meta_charset(page.format(tag).encode("cp1251")) == "windows-1251"
        assert warc.decoded(page.format(tag).encode("cp1251"), "text/html")[0].endswith("<p>Привет, мир</p></body>")
    assert warc.meta_charset(b"<meta " * 100_000 + b"charset=x") is None
    assert warc.meta_charset(b"<p>charset=koi8-r<metadata charset=koi8-r>") is None


def test_errors_are_part_of_the_result(spark):
    broken = b"no record"
    got = warc.build_derivatives(spark.createDataFrame([("k", bytearray(broken))], "k string, record binary"), "k", "record").first()
    assert got["error"] and got["record"] is None
    assert "error" in warc.page_derivatives(spark.createDataFrame([(1, "u", "h")], "page_id bigint, url string, html string")).columns
