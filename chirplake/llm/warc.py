"""WARC derivatives: metadata and plain-text conversion records of HTTP responses."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirplake.llm.html_density import Scanner, page_text
from chirplake.llm.util import bounded_batches, map_rows, unused

VERSION = b"WARC/1.1"
Headers = list[tuple[str, str]]
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_META = re.compile(r"<meta(?=[\s/])", re.I)
_NAMES_CHARSET = re.compile(rb"charset", re.I)
_BYTE_ORDER = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
#: Most bytes that a compressed payload may unpack to; one of more is an error, as it may be made to fill the memory.
MAX_UNPACKED = 1 << 28
_SPACES = re.compile(r"[\x00-\x20\x7f]+")


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as WARC digests are written."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def value(headers: Headers, name: str) -> str | None:
    name = name.lower()
    return next((v for k, v in headers if k.lower() == name), None)


def write_record(headers: Headers, block: bytes) -> bytes:
    """One record; Content-Length is set from the block. Line ends and other controls in values become spaces."""
    lines = [VERSION]
    for name, text in [(k, v) for k, v in headers if k.lower() != "content-length"]:
        lines.append(f"{name}: {_SPACES.sub(' ', text).strip()}".encode())
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header_block(data: bytes) -> Headers:
    out: Headers = []
    for line in data.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and out:  # a folded line
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, text = line.partition(":")
            out.append((name.strip(), text.strip()))
    return out


def read_record(data: bytes) -> tuple[Headers, bytes]:
    """Headers and block of the first record; ValueError if it is none."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not first.startswith(b"WARC/") or not gap:
        raise ValueError("not a WARC record")
    headers = _header_block(lines)
    size = value(headers, "Content-Length")
    if size is None or not size.isdigit() or int(size) > len(rest):
        raise ValueError("the block is cut short")
    return headers, rest[: int(size)]


def read_records(data: bytes) -> Iterator[bytes]:
    """The records of an uncompressed WARC file, as bytes."""
    at = 0
    while at < len(data):
        gap = data.find(b"\r\n\r\n", at)
        size = value(_header_block(data[at:gap]), "Content-Length") if gap >= 0 else None
        if size is None or not size.isdigit():
            raise ValueError("not a WARC record")
        end = gap + 4 + int(size)
        yield data[at : end + 4]
        at = end + 4


def split_http(block: bytes) -> tuple[str, Headers, bytes]:
    """Status line, headers and payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/"):
        return "", [], block
    first, _, lines = head.partition(b"\r\n")
    return first.decode("latin-1"), _header_block(lines), payload if gap else b""


def without_chunks(body: bytes) -> bytes:
    """The body of a chunked transfer; as it is, if it is not of chunks (many writers undo them and leave the header)."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        digits = body[at:end].split(b";")[0].strip() if 0 <= end < at + 1024 else b""
        if not digits or len(digits) > 15 or digits.strip(b"0123456789abcdefABCDEF"):
            return b"".join(out) if out else body  # cut short: what came
        size = int(digits, 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def _inflated(body: bytes, bits: int, limit: int) -> bytes:
    """All members of a deflated body; a body that is cut short gives what it holds."""
    out, size = [], 0
    while body:
        member = zlib.decompressobj(bits)
        part = member.decompress(body, limit - size + 1)
        size += len(part)
        if size > limit:
            raise ValueError(f"the payload unpacks to more than {limit} bytes")
        out.append(part)
        body = member.unused_data if bits > 15 else b""
    return b"".join(out)


def unpacked(payload: bytes, http: Headers, limit: int = MAX_UNPACKED) -> bytes:
    """The payload without its transfer and content codings (chunked, gzip, deflate, zstd), the last applied first.

    A coding that the payload turns out not to have is passed over; one that
    cannot be undone here, or more than ``limit`` bytes, is a ValueError.
    """
    codings = [c.strip().lower() for name in ("Content-Encoding", "Transfer-Encoding") for c in (value(http, name) or "").split(",")]
    for coding in reversed([c for c in codings if c not in ("", "identity")]):
        try:
            if coding == "chunked":
                payload = without_chunks(payload)
            elif coding in ("gzip", "x-gzip"):
                payload = _inflated(payload, 31, limit) if payload[:2] == b"\x1f\x8b" else payload
            elif coding == "deflate":
                payload = _inflated(payload, 15 if payload[:1] == b"\x78" else -15, limit)
            elif coding == "zstd" and payload[:4] == b"\x28\xb5\x2f\xfd":
                import zstandard

                with zstandard.ZstdDecompressor().stream_reader(payload, read_across_frames=True) as reader:
                    payload = reader.read(limit + 1)
                if len(payload) > limit:
                    raise ValueError(f"the payload unpacks to more than {limit} bytes")
            elif coding != "zstd":
                raise ValueError(f"the coding {coding!r} cannot be undone")
        except zlib.error:
            if coding != "deflate":
                raise ValueError(f"the payload is no {coding}") from None
    return payload


def meta_charset(payload: bytes) -> str | None:
    """The charset that the first meta tag with one names, by attribute or in its content, however long the tags are."""
    if not _NAMES_CHARSET.search(payload):
        return None
    page = payload.decode("latin-1")
    scanner = Scanner(page)
    for found in _META.finditer(page):
        tag = scanner.start_tag(found.start())
        if tag is None:  # this one never ends, so none after it does
            return None
        named = tag[1].get("charset") or ((found := _CHARSET.search(tag[1].get("content", ""))) and found[1])
        if named and named.strip():
            return named.strip()
    return None


def decoded(payload: bytes, content_type: str | None) -> tuple[str, str]:
    """Text and charset: by byte order mark, of the HTTP header, of the page's first meta element that names one, else UTF-8; unknown charsets fall back to UTF-8."""
    marked = next((name for mark, name in _BYTE_ORDER if payload.startswith(mark)), None)
    named = None if marked else _CHARSET.search(content_type or "")
    charset = (marked or (named[1] if named else meta_charset(payload)) or "utf-8").lower()
    try:
        return payload.decode(charset, "replace"), charset
    except (LookupError, UnicodeError, ValueError):
        return payload.decode("utf-8", "replace"), "utf-8"


def record_id(*parts: str) -> str:
    """A record identifier that depends on nothing but its parts, so that a task that runs again gives the same."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256('|'.join(parts).encode()).digest()[:16], version=5)}>"


def derive(record: bytes) -> list[tuple[str, Headers, bytes]]:
    """Metadata and conversion record (kind, headers, block) of a response record.

    Both refer to the response by WARC-Refers-To, carry its target, its date and
    the digests of its block and payload, and name one another by
    WARC-Concurrent-To; the metadata record also holds the source's headers. The
    conversion is made of the payload without its transfer and content codings
    (:func:`unpacked`). A record that is no response gives none.
    """
    headers, block = read_record(record)
    if (value(headers, "WARC-Type") or "").lower() != "response":
        return []
    status, http, payload = split_http(block)
    source = value(headers, "WARC-Record-ID") or record_id("response", digest(block))
    block_digest = value(headers, "WARC-Block-Digest") or digest(block)
    payload_digest = value(headers, "WARC-Payload-Digest") or digest(payload)
    body = unpacked(payload, http)
    text, charset = decoded(body, value(http, "Content-Type"))
    html = "html" in (value(http, "Content-Type") or "html").lower()
    plain = (page_text(text) if html else text).encode("utf-8", "replace")
    shared = [(n, v) for n in ("WARC-Target-URI", "WARC-Date", "WARC-Warcinfo-ID") if (v := value(headers, n)) is not None]
    shared += [("WARC-Refers-To", source), ("WARC-Source-Block-Digest", block_digest), ("WARC-Source-Payload-Digest", payload_digest)]
    names = {kind: record_id(kind, source, block_digest) for kind in ("metadata", "conversion")}
    fields = [("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("source-status", status), ("charset", charset), ("unpacked-bytes", str(len(body)))]
    fields += [(f"source-warc-{k}", v) for k, v in headers] + [(f"source-http-{k}", v) for k, v in http]
    fields += [("conversion-digest", digest(plain)), ("conversion-characters", str(len(plain.decode())))]
    meta = b"".join(f"{k}: {_SPACES.sub(' ', v).strip()}\r\n".encode() for k, v in fields)
    out = []
    for kind, content, body, other in (("metadata", "application/warc-fields", meta, "conversion"), ("conversion", "text/plain; charset=utf-8", plain, "metadata")):
        own = [("WARC-Type", kind), ("WARC-Record-ID", names[kind]), *shared, ("WARC-Concurrent-To", names[other]), ("WARC-Block-Digest", digest(body)), ("Content-Type", content)]
        out.append((kind, own, body))
    return out


def response_record(page_id: int | None, url: str | None, html: str | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record of a page as if it had just been fetched. Its id follows from the page's number, address and content, so rows that are alike in all three are one record."""
    payload = (html or "").encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", record_id("page", str(page_id), url or "", digest(payload))), ("WARC-Target-URI", url or ""), ("WARC-Date", date)]
    headers += [("WARC-Block-Digest", digest(block)), ("WARC-Payload-Digest", digest(payload)), ("Content-Type", "application/http; msgtype=response")]
    return write_record(headers, block)


_OUT = "record_type string, record_id string, refers_to string, target_uri string, concurrent_to string, source_payload_digest string, block_digest string, block binary, record binary, error string"
_KINDS = [pa.string()] * 7 + [pa.binary(), pa.binary(), pa.string()]


def _derived_rows(record: bytes | None) -> list[tuple]:
    try:
        got = derive(record or b"")
        payload = digest(split_http(read_record(record or b"")[1])[2])
    except ValueError as e:
        return [(None,) * 9 + (str(e),)]
    rows = []
    for kind, headers, block in got:
        stated = [value(headers, n) for n in ("WARC-Record-ID", "WARC-Refers-To", "WARC-Target-URI", "WARC-Concurrent-To")]
        rows.append((kind, *stated, payload, value(headers, "WARC-Block-Digest"), block, write_record(headers, block), None))
    return rows


def build_derivatives(responses: DataFrame, key: str, record: str) -> DataFrame:
    """Derivatives of a binary column of WARC records: key, the record's parts, its bytes, and ``error``.

    Two rows a response, none for records of other types, one with a reason in
    ``error`` for what is no record (null and empty too) or cannot be unpacked.
    Keys may repeat or be null. Other columns are not returned. Each record is
    worked on by itself and whole, however long, so the plan has no shuffle. An
    empty table gives an empty table. A key column that has the name of one of the
    record's parts is an error.
    """
    if unused(responses.select(F.col(f"`{key}`")), *(own := [c.split()[0] for c in _OUT.split(", ")])) != own:
        raise ValueError(f"the key column may not be named like one of {', '.join(own)}")
    schema = responses.select(F.col(f"`{key}`")).schema
    for part in _OUT.split(", "):
        schema = schema.add(*part.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                for row in _derived_rows(data):
                    index.append(i)
                    rows.append(row)
            columns = zip(*rows, strict=True) if rows else [()] * len(_KINDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True))], schema.names)

    return map_rows(responses.select(F.col(f"`{key}`"), F.col(f"`{record}`").cast("binary").alias("data")), run, schema)


def page_responses(pages: DataFrame) -> DataFrame:
    """page_id and response record (binary) of each row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [response_record(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["page_id", "record"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return bounded_batches(rows).mapInArrow(run, "page_id bigint, record binary")


def page_derivatives(pages: DataFrame) -> DataFrame:
    """The metadata and conversion records of all rows of ``pages`` (page_id, url, html; other columns are ignored), whole and with checksums.

    Null urls and pages are empty ones; a null page_id stays null. Rows that
    repeat give their records again. What cannot be unpacked is a row with a reason in
    ``error`` and no record. An empty table gives an empty table.
    """
    out = build_derivatives(page_responses(pages), "page_id", "record")
    return out.select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", "concurrent_to", "source_payload_digest", "block_digest",
        F.octet_length("block").cast("bigint").alias("block_bytes"), F.sha2("block", 256).alias("block_sha256"), F.sha2("record", 256).alias("record_sha256"), "record", "error",
    )


def write_warc(derivatives: DataFrame, path: str) -> None:
    """Write the records of :func:`build_derivatives` into WARC files, part-*.warc.gz in the folder ``path``.

    Metadata and conversion records are UTF-8 and each ends in two line ends, so
    Spark's own text writer, with those as its line end, writes them as they are,
    with its commit protocol and on any file system that Spark can reach. Each file
    is compressed as a whole.
    """
    ending = F.octet_length("record") - 4
    lines = derivatives.where("record is not null").select(F.decode(F.substring("record", F.lit(1), ending), "UTF-8").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)
    jvm = derivatives.sparkSession.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(derivatives.sparkSession.sparkContext._jsc.hadoopConfiguration())
    for status in system.listStatus(folder):
        name = status.getPath().getName()
        if name.endswith(".txt.gz"):
            system.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(".txt.gz") + ".warc.gz"))
