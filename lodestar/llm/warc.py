"""Legacy web archives (ARC 1 and 2) converted to WARC 1.1, written and read by Spark.

An ARC record is one header line, whose fields depend on the version that the archive's
first record declares, and as many bytes as the line's last field says. From these a
WARC record is made: identifier, timestamp, type and digests follow from its content,
so a repeated run gives the same archive.

Edge cases: a null payload is empty; null keys and URLs are left out of the headers
and read back as null; payloads may hold anything, also text that looks like a
header, as lengths alone separate records; of several rows with the same largest key and an equal payload
all are responses; an empty table gives an archive without records; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_types, map_rows, materialise, scratch_path

#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT = 1000
#: Bytes of payload that one archive file is made for.
ARCHIVE_BYTES = 24_000_000
#: The header fields of the two legacy versions, as their first records state them.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Fixed value: the profile of a revisit by equal payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:lodestar:warc")
_KEY = b"X-Source-Key: "


# -- the legacy side -------------------------------------------------------------------


def arc_header(version: int, name: str, date: str) -> bytes:
    """The first record of an ARC archive, which declares its version."""
    body = f"{version} 0 lodestar\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": "0", "Filename": name, "Archive-length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(version: int, url: str | None, date: str, body: bytes, name: str = "-", offset: int = 0) -> bytes:
    """One ARC record. Blanks of the URL are percent-encoded, as the header line is split at blanks."""
    safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or "-"
    fields = {"URL": safe, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(body))}
    return " ".join(fields[f] for f in ARC_FIELDS[version]).encode("utf-8", "surrogatepass") + b"\n" + body + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC archive as dictionaries of header fields, with ``body``.

    The fields of a line are taken from the right, as URLs of old archives may hold blanks. Raises ValueError for an unknown version, a header line with
    fewer fields, or a declared length beyond the end.
    """
    view, at, fields = memoryview(data), 0, None
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line at byte {at} has no end")
        line = data[at:end].decode("utf-8", "surrogatepass").split(" ")
        if fields is None:
            if not line[0].startswith("filedesc://"):
                raise ValueError("an ARC archive begins with a filedesc record")
            length = int(line[-1])
            stated = bytes(view[end + 1 : end + 1 + length]).split(b"\n")
            version = int(stated[0].split(b" ")[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            fields = ARC_FIELDS[version]
        else:
            if len(line) < len(fields):
                raise ValueError(f"ARC header line at byte {at} has {len(line)} fields, not {len(fields)}")
            line = [" ".join(line[: len(line) - len(fields) + 1]), *line[len(line) - len(fields) + 1 :]]
            length = int(line[-1])
            if end + 1 + length > len(data):
                raise ValueError(f"ARC record at byte {at} is cut off")
            yield dict(zip(fields, line, strict=True)) | {"body": bytes(view[end + 1 : end + 1 + length])}
        at = end + 1 + length


# -- the new side ----------------------------------------------------------------------


def _date(arc: str) -> str:
    """20260102030405 as 2026-01-02T03:04:05Z; shorter dates are filled up."""
    d = (arc + "00000101000000"[len(arc) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_id(key: object, url: str | None, digest: str) -> str:
    """An identifier that follows from the row."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, json.dumps([None if key is None else str(key), url, digest]))}>"


def _base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def warc_record(key: object, url: str | None, arc: dict, of_key: object, of_url: str | None, payload_digest: str) -> bytes:
    """The WARC record of an ARC record; a revisit, without payload, if ``of_key`` is given."""
    head, _, payload = arc["body"].partition(b"\r\n\r\n")
    head += b"\r\n\r\n"
    revisit = of_key is not None
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(key, url, payload_digest)}",
        f"WARC-Date: {_date(arc['Archive-date'])}",
        *([f"WARC-Target-URI: {arc['URL']}"] if url else []),
        f"WARC-Payload-Digest: sha1:{_base32(payload_digest)}",
        f"WARC-Block-Digest: sha1:{_base32(hashlib.sha1(block).hexdigest())}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(of_key, of_url, payload_digest)}", f"X-Refers-To-Key: {of_key}"] if revisit else []),
        *([f"X-Source-Key: {key}"] if key is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """Header fields and block of each record of an uncompressed archive, by declared lengths."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        if data[at : at + 7] != b"WARC/1." or (end := data.find(b"\r\n\r\n", at)) < 0:
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:end].decode("utf-8", "surrogatepass").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        if end + 4 + length > len(data):
            raise ValueError(f"WARC record at byte {at} is cut off")
        yield fields, view[end + 4 : end + 4 + length]
        at = end + 4 + length


# -- Spark -----------------------------------------------------------------------------


def with_originals(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Pages (page_id, url, html) with ``digest`` and, for revisits, the response's ``of_id`` and ``of_url``.

    Which pages are revisits is found over digests and keys alone; a frequent payload is one row of a written table, so that Spark can split the rows that
    meet it. Payloads are joined by their own key and digest, which aren't frequent; they move only where the table of revisits is too large to be broadcast.
    """
    # the digest of text is that of its UTF-8 bytes
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1("html"))
    large = rows.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "url", "digest")
    groups = large.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("of"), F.min("page_id").alias("low")).where(F.col("low") < F.col("of.page_id"))
    groups = materialise(groups.select(F.col("digest").alias("of_digest"), F.col("of.page_id").alias("of_id"), F.col("of.url").alias("of_url")), "warc-groups")
    late = large.select("page_id", "digest").join(groups, F.col("digest") == F.col("of_digest")).where(F.col("page_id") < F.col("of_id"))
    late = materialise(late.select(F.col("page_id").alias("late_id"), "of_digest", "of_id", "of_url").distinct(), "warc-revisits")
    joined = rows.join(late, (F.col("page_id") == F.col("late_id")) & (F.col("digest") == F.col("of_digest")), "left")
    return joined.select("page_id", "url", "html", "digest", "of_id", "of_url")


def convert_pages(pages: DataFrame, date: str = "20260101000000", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(record binary): WARC records of pages, by way of ARC archives that are packed and parsed in each task.

    Keys that are even are packed by version 1, others by version 2.
    """

    def run(batch: pa.RecordBatch) -> list:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True))
        out: list[bytes] = []
        for version in (1, 2):
            own = [r for r in rows if ((r[0] or 0) % 2 == 0) == (version == 1)]
            if not own:
                continue
            parts, offset = [arc_header(version, "pages.arc", date)], 0
            for _, url, html, *_ in own:
                payload = (html or "").encode("utf-8", "surrogatepass")
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
                offset += len(parts[-1])
                parts.append(arc_record(version, url, date, head + payload, "pages.arc", offset))
            out += [warc_record(r[0], r[1], arc, r[4], r[5], r[3]) for r, arc in zip(own, parse_arc(b"".join(parts)), strict=True)]
        return [out]

    return map_rows(with_originals(pages, min_bytes), run, "record binary")


def unpacked(data: bytes) -> bytes:
    """An archive as it is, or all gzip members of one that is compressed; each record may be a member of its own."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out += [member.decompress(data), member.flush()]
        data = member.unused_data
    return b"".join(out) if out else data


_ARC = "file string, nth bigint, url string, ip string, archive_date string, content_type string, body binary"


def read_arc(spark: SparkSession, path: str, pattern: str = "*.arc*") -> DataFrame:
    """(file, nth, url, ip, archive_date, content_type, body): the records of all ARC archives below ``path``, compressed or not; one that can't be parsed fails the job.

    An archive is read by one task; legacy writers keep them to some hundred megabytes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    types, names = arrow_types(spark, _ARC), ("URL", "IP-address", "Archive-date", "Content-type", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for some in itertools.batched(enumerate(parse_arc(unpacked(blob.as_py()))), 256):
                    columns = zip(*((at, nth, *(r[x] for x in names)) for nth, r in some), strict=True)
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, types, strict=True)], schema=types)

    return files.mapInArrow(run, _ARC)


def convert_arc(arcs: DataFrame) -> DataFrame:
    """(record binary): WARC response records of what ``read_arc`` gives, ready for ``write_warc``. Their identifiers follow from file, place, URL and payload."""

    def run(batch: pa.RecordBatch) -> list:
        out = []
        for file, nth, url, date, body in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            arc = {"URL": url, "Archive-date": date, "body": body}
            digest = hashlib.sha1(body.partition(b"\r\n\r\n")[2]).hexdigest()
            record = warc_record(None, url, arc, None, None, digest)
            own = record_id(f"{file}#{nth}", url, digest)  # records of several archives may be equal
            out.append(record.replace(record_id(None, url, digest).encode(), own.encode(), 1))
        return [out]

    return map_rows(arcs.select("file", "nth", "url", "archive_date", "body"), run, "record binary")


def write_warc(records: DataFrame, path: str, per_file: int = 10_000) -> None:
    """Write records as gzip archives: each part file is up to ``per_file`` WARC records that end with two line breaks."""
    rows = records.select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``: key, url, type, date, identifiers, payload, its size and digest.

    A revisit has no payload here; size and digest are those that its headers state,
    and a response's digest is computed and held against the stated one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "url", "type", "date", "record_id", "refers_to", "refers_key", "payload_bytes", "payload_digest", "payload"]
        types = pa.schema([(n, pa.int64() if n in ("key", "refers_key", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names])
        for batch in batches:
            for blob in batch.column(0):
                data = blob.as_py()
                if data[:2] == b"\x1f\x8b":
                    data = zlib.decompress(data, 31)
                rows = []
                for f, block in parse_warc(data):
                    raw = bytes(block)
                    head, _, payload = raw.partition(b"\r\n\r\n")
                    stated = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    if f["warc-type"] == "revisit":
                        sizes = [int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                        size, payload = sizes[0] if sizes else None, None
                    else:
                        size = len(payload)
                        if hashlib.sha1(payload).hexdigest() != stated:
                            raise ValueError(f"payload digest of {f['warc-record-id']} differs")
                    number = lambda name, f=f: int(f[name]) if name in f else None
                    rows.append((number("x-source-key"), f.get("warc-target-uri"), f["warc-type"], f["warc-date"], f["warc-record-id"], f.get("warc-refers-to"), number("x-refers-to-key"), size, stated, payload))
                    if len(rows) == 256:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema=types)

    return files.mapInArrow(run, "key bigint, url string, type string, date string, record_id string, refers_to string, refers_key bigint, payload_bytes bigint, payload_digest string, payload binary")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives written from pages and read again."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    size = pages.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("html").cast("string"))), F.lit(0)).alias("bytes")).first()
    write_warc(convert_pages(pages), path, max(1, int(ARCHIVE_BYTES * size["n"] // max(1, size["bytes"]))))
    return read_warc(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.col("refers_key").alias("refers_to"))
