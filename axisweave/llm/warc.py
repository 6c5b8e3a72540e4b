"""Legacy archive converter: ARC records to WARC records, and a reader for what was written.

ARC (versions 1 and 2): a ``filedesc://`` version block names the version and the fields of each record's header line;
a record is that line, then as many bytes as it declares, then a line feed. The converter synthesises the WARC
fields an ARC record has no place for: record id, ISO date, record type, block and payload digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisweave.llm.common import pieces, prepare, shared_dir, store

#: The header line's fields by ARC version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "X-Page-Id"
CONVERTED = "page_id long, url string, ip string, date string, record_id string, http binary, payload binary, payload_bytes long, payload_digest string"
KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
#: What stands between two records of a file: a gzip member of nothing.
BETWEEN = gzip.compress(b"", mtime=0)
#: Bytes that a gzip member is given at a time.
WINDOW = 1 << 14
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, date string, record_id string, digest_ok boolean"


class ArchiveError(ValueError):
    """An archive breaks its format."""


def unzipped(raw: bytes) -> bytes:
    """The content of all members of a gzip file, or the bytes of another file."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out, at, all_ = [], 0, memoryview(raw)
    while at < len(raw):
        member = zlib.decompressobj(31)
        while not member.eof and at < len(raw):  # by WINDOW, as what follows a member is copied
            out.append(member.decompress(all_[at : at + WINDOW]))
            at = min(at + WINDOW, len(raw))
        if not member.eof:
            raise ArchiveError("a gzip member is cut")
        at -= len(member.unused_data)
        while at < len(raw) and not raw[at]:
            at += 1
    return b"".join(out)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def safe_url(url: str | None) -> str:
    """A URL fit for a header line: spaces and control characters are percent-encoded; null and empty become about:blank."""
    return quote(url, safe="".join(map(chr, range(0x21, 0x7F)))) if url else "about:blank"


def arc_bytes(pages: Iterator[tuple], version: int, date: str = "20240101000000", name: str = "pages.arc") -> bytes:
    """An ARC file of (page_id, url, html bytes); the content is an HTTP response that carries the page id in a header."""
    fields = ARC_FIELDS[version]
    body = f"{version} 0 Archive\n{fields}\n".encode()
    tail = f" 200 - - 0 {name}" if version == 2 else ""
    out = io.BytesIO()
    out.write(f"filedesc://{name} 0.0.0.0 {date} text/plain{tail} {len(body)}\n".encode() + body + b"\n")
    for page_id, url, html in pages:
        content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{PAGE}: {'-' if page_id is None else page_id}\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html
        tail = f" 200 {zlib.crc32(content):08x} - {out.tell()} {name}" if version == 2 else ""
        out.write(f"{safe_url(url)} 192.0.2.1 {date} text/html{tail} {len(content)}\n".encode() + content + b"\n")
    return out.getvalue()


def parse_arc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record after the version block. Raises ArchiveError on a broken or cut file.

    The names of the fields come from the version block, so both versions and own field lists are read; a URL with spaces
    is kept, as the fields after it are counted from the right.
    """
    names: list[str] = []
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if not parts[-1].isdigit():
            raise ArchiveError(f"no length in header line {line[:80]!r}")
        content = stream.read(int(parts[-1]))
        if len(content) < int(parts[-1]):
            raise ArchiveError(f"record of {parts[-1]} bytes is cut after {len(content)}")
        if not names:
            if not parts[0].startswith("filedesc:"):
                raise ArchiveError("an ARC file begins with filedesc:")
            block = content.decode("utf-8", "replace").split("\n")
            if len(block) < 2 or block[0].split(" ")[0] not in ("1", "2"):
                raise ArchiveError(f"unknown version block {content[:80]!r}")
            names = block[1].split(" ")
            continue
        if len(parts) < len(names):
            raise ArchiveError(f"{len(parts)} fields, not {len(names)}, in {line[:80]!r}")
        rest = len(names) - 1
        yield dict(zip(names, [" ".join(parts[:-rest]), *parts[-rest:]], strict=True)), content


def record_uuid(page_id: int | None, digest: str) -> str:
    """A version-8 UUID (custom layout): the page id's 64 bits, then bits of the payload digest. The id can be read back."""
    low = int.from_bytes(base64.b32decode(digest)[:8], "big")
    top = (0 if page_id is None else page_id) & (1 << 64) - 1
    flag = 1 if page_id is None else 0
    value = (top >> 16) << 80 | 8 << 76 | (top >> 4 & 0xFFF) << 64 | 2 << 62 | (top & 0xF) << 58 | flag << 57 | low & (1 << 57) - 1
    x = f"{value:032x}"
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def uuid_page(record_id: str) -> int | None:
    v = int(record_id.removeprefix("<urn:uuid:").removesuffix(">").replace("-", ""), 16)
    if v >> 57 & 1:
        return None
    top = v >> 80 << 16 | (v >> 64 & 0xFFF) << 4 | v >> 58 & 0xF
    return top - (1 << 64) if top >> 63 else top


def convert(fields: dict[str, str], content: bytes) -> dict:
    """The parts of a WARC record for an ARC record whose content is an HTTP response."""
    head, sep, payload = content.partition(b"\r\n\r\n")
    if not content.startswith(b"HTTP/") or not sep:
        head, payload = b"", content
    http = head.decode("latin-1")  # a character for each byte
    page = next((x.split(":", 1)[1].strip() for x in http.split("\r\n") if x.lower().startswith(PAGE.lower() + ":")), "-")
    page_id = int(page) if re.fullmatch(r"-?\d{1,18}", page) else None
    d, digest = fields["Archive-date"].ljust(14, "0"), sha1_base32(payload)
    return {
        "page_id": page_id, "url": fields["URL"], "ip": fields["IP-address"], "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
        "record_id": record_uuid(page_id, digest), "http": head, "payload": payload, "payload_bytes": len(payload), "payload_digest": digest,
    }


def warc_record(r: dict, refers_to: int | None, revisit: bool) -> bytes:
    """A record with the two line ends that close it. A revisit keeps the HTTP header and leaves out the payload."""
    head = r["http"] + b"\r\n\r\n" if r["http"] else b""
    block = head if revisit else head + r["payload"]
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response' if head else 'resource'}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['date']}", f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}",
        f"Content-Type: {'application/http;msgtype=response' if head else 'text/html'}", f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"X-Payload-Length: {r['payload_bytes']}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uuid(refers_to, r['payload_digest'])}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ArchiveError(f"no WARC record at {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) and line != b"\r\n":
            k, _, v = line.decode("utf-8").partition(":")
            fields[k.lower()] = v.strip()
        block = stream.read(size := int(fields["content-length"]))
        if len(block) < size:
            raise ArchiveError(f"record of {size} bytes is cut after {len(block)}")
        yield fields, block


def _arc_records(part: pa.RecordBatch, version: int) -> Iterator[dict]:
    """Rows (page_id, url, html) through an ARC image and the converter."""
    rows = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
    image = arc_bytes(((i, u, h or b"") for i, u, h in rows), version)
    return (convert(*x) for x in parse_arc(io.BytesIO(image)))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], KINDS[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def read_arc(spark, path: str) -> DataFrame:
    """The records of ARC files (versions 1 and 2 or with fields of their own, gzipped or not) under path, converted: see CONVERTED.

    page_id is what a header X-Page-Id of the content tells, else null. A file is read as a whole by one task. A broken file raises ArchiveError.
    """
    names = [x.split(" ")[0] for x in CONVERTED.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found, held = [], 0
                for x in parse_arc(io.BytesIO(unzipped(content.as_py() or b""))):
                    found.append(tuple(convert(*x)[n] for n in names))
                    held += len(x[1])
                    if held > 8_000_000:
                        yield _batch(found, CONVERTED)
                        found, held = [], 0
                yield _batch(found, CONVERTED)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, CONVERTED)


def write_warc(records: DataFrame, path: str) -> None:
    """Converted records (see CONVERTED; refers_to and revisit may follow, else none revisits another) to WARC files under path, one for each partition,
    each record a gzip member of its own.

    Spark's text writer commits the files, so lost tasks leave none. It writes a string's bytes as they are; the line end is an empty member.
    """
    more = [F.col(c) if c in records.columns else F.lit(None).cast(t).alias(c) for c, t in (("refers_to", "long"), ("revisit", "boolean"))]
    rows = records.select(*[x.split(" ")[0] for x in CONVERTED.split(", ")], *more)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [gzip.compress(warc_record(r, r["refers_to"], bool(r["revisit"])), 4, mtime=0) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).view(pa.string())], ["value"])

    rows.mapInArrow(members, "value string").write.option("encoding", "ISO-8859-1").option("lineSep", BETWEEN.decode("latin-1")).text(path)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0) -> None:
    """Pages, by way of ARC records, to WARC files under path (see write_warc()). html is text (its UTF-8 bytes) or binary.

    Of records with equal payloads of at least min_revisit_bytes, that of the largest page id is the response and the others
    revisit it. Null html is an empty payload; a null url becomes about:blank; a null page id is below all others; rows that
    repeat the largest page id are responses all.
    """
    prepare(pages.sparkSession)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("binary").alias("html"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            for part in pieces(batch, "html"):
                found = [(r["page_id"], r["payload_bytes"], base64.b32decode(r["payload_digest"]).hex()) for r in _arc_records(part, 1 + k % 2)]
                yield _batch(found, "page_id long, size long, digest string")

    listed = store(rows.mapInArrow(digests, "page_id long, size long, digest string")).where(F.col("size") >= min_revisit_bytes)
    first = listed.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = listed.join(first, "digest").where("page_id < refers_to or (page_id is null and refers_to is not null)").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "refers_to", F.lit(True).alias("revisit")).distinct()
    same = rows["page_id"].eqNullSafe(revisits["_id"]) & (F.sha1(F.coalesce(rows["html"], F.encode(F.lit(""), "UTF-8"))) == revisits["_digest"])
    marked = rows.join(revisits, same, "left").select(rows["*"], "refers_to", "revisit")
    names = [x.split(" ")[0] for x in CONVERTED.split(", ")]

    def converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            for part in pieces(batch, "html"):
                marks = zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)
                yield _batch([(*[r[n] for n in names], *m) for r, m in zip(_arc_records(part, 1 + k % 2), marks, strict=True)], f"{CONVERTED}, refers_to long, revisit boolean")

    write_warc(marked.mapInArrow(converted, f"{CONVERTED}, refers_to long, revisit boolean"), path)


def read_archives(spark, path: str) -> DataFrame:
    """The records of WARC files (gzipped or not) under path; payload figures are of the full payload, for revisits as declared."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                for fields, block in parse_warc(io.BytesIO(unzipped(content.as_py() or b""))):
                    if fields["warc-type"] not in ("response", "resource", "revisit"):
                        continue
                    head, sep, payload = block.partition(b"\r\n\r\n")
                    if fields["warc-type"] == "resource" or not sep:
                        payload = block
                    again = fields["warc-type"] == "revisit"
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    own = digest if again else sha1_base32(payload)
                    out.append((
                        uuid_page(fields["warc-record-id"]), int(fields["x-payload-length"]) if again else len(payload), own, fields["warc-type"],
                        uuid_page(fields["warc-refers-to"]) if again else None, fields.get("warc-target-uri"), fields.get("warc-date"), fields["warc-record-id"], own == digest,
                    ))
                yield _batch(out, READ)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, READ)


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages as WARC files into path (default: a new folder in the shared one) and read them back."""
    import uuid

    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/axisweave/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
