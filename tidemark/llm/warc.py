"""WARC records in ZIP-packaged archives: written, and read by range without extraction.

An archive is a ZIP file whose members are stored, not deflated: ``archive/data.warc.gz`` (one gzip
member a record) and ``indexes/index.cdxj`` (one JSON line a record: id, offset and length within the
WARC member). A reader takes the end of the file, follows the ZIP64 locator where there is one, parses
the central directory, and then asks only for the byte ranges of the records it wants.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.llm.scratch import Scratch, lean, width

#: Compressed bytes of records in one archive, and of neighbouring records fetched by one read.
ROLL, FETCH = 32 << 20, 4 << 20
#: Payloads below so many bytes are never written as revisits.
LEAST = 100
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

# Fixed values of the ZIP format.
END, END64, LOCATOR64, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
NO32, NO16 = 0xFFFFFFFF, 0xFFFF


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    crc: int
    stored: int
    size: int
    header: int


def directory(read: Callable[[int, int], bytes], size: int) -> list[Member]:
    """The members of a ZIP file, from its central directory (ZIP64 or not)."""
    tail_at = max(0, size - (1 << 16) - 22)
    tail = read(tail_at, size - tail_at)
    k = tail.rfind(END)
    while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
        k = tail.rfind(END, 0, k)  # the mark can stand within the comment
    if k < 0:
        raise ValueError("no end of central directory: not a ZIP file, or cut short")
    count, length, start = struct.unpack_from("<HII", tail, k + 10)
    if count == NO16 or length == NO32 or start == NO32:
        locator = read(tail_at + k - 20, 20)
        if locator[:4] != LOCATOR64:
            raise ValueError("ZIP64 end of central directory is not located")
        end64 = read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if end64[:4] != END64:
            raise ValueError("ZIP64 end of central directory is not where the locator says")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    entries, at, out = read(start, length), 0, []
    for _ in range(count):
        if entries[at : at + 4] != CENTRAL:
            raise ValueError(f"central directory is damaged at {at}")
        flags, method = struct.unpack_from("<HH", entries, at + 8)
        crc, stored, plain, n_name, n_extra, n_note = struct.unpack_from("<IIIHHH", entries, at + 16)
        (header,) = struct.unpack_from("<I", entries, at + 42)
        name = entries[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = entries[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n = struct.unpack_from("<HH", extra)
            if tag == 1:  # only the fields that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{min(n, 24) // 8}Q", extra, 4))
                plain = next(wide) if plain == NO32 else plain
                stored = next(wide) if stored == NO32 else stored
                header = next(wide) if header == NO32 else header
            extra = extra[4 + n :]
        out.append(Member(name, method, crc, stored, plain, header))
        at += 46 + n_name + n_extra + n_note
    return out


def begins(read: Callable[[int, int], bytes], member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    head = read(member.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"{member.name} has no local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + n_name + n_extra


def record(fields: list[tuple[str, object]], payload: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member of its own."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(payload))] if v is not None)
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + payload + b"\r\n\r\n", 1, mtime=0)


def parse(plain: bytes) -> tuple[dict[str, str], bytes]:
    """Fields, names in lower case, and payload of a decompressed record."""
    head, _, rest = plain.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


#: Compressed bytes handed to zlib at a time: what lies beyond a member's end is copied by it.
STEP = 1 << 14


def members_of(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and decompressed bytes of each gzip member."""
    view, at = memoryview(data), 0
    while at < len(data):
        one, plain, end = zlib.decompressobj(31), [], at
        while not one.eof:
            piece = view[end : end + STEP]
            if not len(piece):
                raise ValueError("the last gzip member is cut short")
            plain.append(one.decompress(piece))
            end += len(piece)
        end -= len(one.unused_data)
        yield at, end - at, b"".join(plain)
        at = end


def records_of(data: bytes) -> Iterator[bytes]:
    return (plain for _, _, plain in members_of(data))


def archive(records: list[tuple[str, bytes]]) -> bytes:
    at, lines = 0, []
    for ident, data in records:
        lines.append(json.dumps({"id": ident, "offset": at, "length": len(data)}))
        at += len(data)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in ((DATA, b"".join(x for _, x in records)), (INDEX, "\n".join(lines).encode())):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=True) as f:
                f.write(data)
    return out.getvalue()


def _shorter(value: str) -> str:
    """A header value must stay on its line."""
    return " ".join(value.split())


def write_archives(pages: DataFrame, folder: str, *, ident: str = "page_id", url: str = "url", payload: str = "html", roll: int = ROLL) -> DataFrame:
    """Writes one record a row of pages and returns (path, records, bytes) of the archives.

    Of equal payloads of at least LEAST bytes the row with the smallest identifier is a response and
    the others revisit it; rows that share that smallest identifier are all responses. A null payload
    is empty; a null identifier comes after all others; a null url is left out. No rows, no archives.
    The result must be materialized before it is used: each run of it writes archives.
    """
    rows = pages.select(F.col(ident).cast("long").alias("wa_id"), F.col(url).cast("string").alias("wa_url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("wa_payload"))
    rows = rows.withColumn("wa_digest", F.sha2("wa_payload", 256))
    digests = pages.select(F.col(ident).cast("long").alias("wa_id"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("wa_payload"))
    digests = digests.filter(F.length("wa_payload") >= LEAST).select("wa_id", F.sha2("wa_payload", 256).alias("wa_of"))
    first = digests.groupBy("wa_of").agg(F.min("wa_id").alias("wa_first"), F.count(F.lit(1)).alias("wa_n")).filter("wa_n > 1").drop("wa_n")
    rows = rows.join(first, rows.wa_digest == first.wa_of, "left").drop("wa_of")
    revisits = F.col("wa_first").isNotNull() & ~F.col("wa_id").eqNullSafe(F.col("wa_first"))
    rows = rows.select("wa_id", "wa_url", "wa_digest", F.length("wa_payload").cast("long").alias("wa_bytes"), F.when(revisits, F.col("wa_first")).alias("wa_first"), F.when(~revisits, F.col("wa_payload")).alias("wa_payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            data = archive(held)
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            files.write(path, data)
            return pa.RecordBatch.from_pydict({"path": [path], "records": [len(held)], "bytes": [len(data)]})

        for batch in batches:
            for x in batch.to_pylist():
                name = "null" if x["wa_id"] is None else str(x["wa_id"])
                seen = x["wa_first"] is not None
                fields = [("WARC-Type", "revisit" if seen else "response"), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Target-URI", x["wa_url"] and _shorter(x["wa_url"])), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{x['wa_digest']}"), ("WARC-Payload-Length", x["wa_bytes"])]
                if seen:
                    fields += [("WARC-Refers-To", f"<urn:page:{x['wa_first']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                data = record(fields, x["wa_payload"] or b"")
                held.append((name, data))
                size += len(data)
                if size >= roll:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.mapInArrow(lean(run), "path string, records long, bytes long")


def read_archives(archives: DataFrame, *, path: str = "path", fetch: int = FETCH) -> DataFrame:
    """(record_id, record_type, url, payload_digest, payload_bytes, refers_to, payload) of every record.

    Digest and length of a response are computed from its payload; those of a revisit are its header's,
    and its payload is null. Archives without an index are scanned once for their gzip members. Null
    paths are skipped, other columns are not read, and an empty table gives an empty table.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if name is None:
                    continue
                read = files.Ranges(name)
                members = {m.name: m for m in directory(read, read.size)}
                for m in members.values():
                    if not m.name.endswith(".warc.gz"):
                        continue
                    base = begins(read, m)
                    index = members.get(INDEX) if m.name == DATA else None
                    if index:
                        lines = read(begins(read, index), index.size).decode().splitlines()
                        found = [(x["offset"], x["length"]) for x in map(json.loads, lines)]
                    else:
                        found = [x[:2] for x in members_of(read(base, m.size))]
                    start, n, out = 0, 0, []
                    for offset, length in found:
                        if n and n + length > fetch:
                            out.append((base + start, n))
                            start, n = offset, 0
                        n += length
                    if n:
                        out.append((base + start, n))
                    if out:
                        yield pa.RecordBatch.from_pydict({"path": [name] * len(out), "start": [a for a, _ in out], "length": [b for _, b in out]})
                read.close()

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                read = files.Ranges(x["path"])
                data = read(x["start"], x["length"])
                read.close()
                rows = []
                for plain in records_of(data):
                    fields, payload = parse(plain)
                    if (kind := fields["warc-type"]) == "response":
                        digest, n = hashlib.sha256(payload).hexdigest(), len(payload)
                    else:
                        digest, n, payload = fields["warc-payload-digest"].removeprefix("sha256:"), int(fields["warc-payload-length"]), None
                    rows.append({"record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "url": fields.get("warc-target-uri"), "payload_digest": digest, "payload_bytes": n, "refers_to": fields.get("warc-refers-to", "").strip("<>") or None, "payload": payload})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([(x, pa.string()) for x in ("record_id", "record_type", "url", "payload_digest")] + [("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
    parts = archives.select(path).mapInArrow(lean(ranges), "path string, start long, length long").repartition(width(archives.sparkSession), "path", "start")
    return parts.mapInArrow(lean(fetched), "record_id string, record_type string, url string, payload_digest string, payload_bytes long, refers_to string, payload binary")


def op5_warc(spark, sf_dir):
    """Per page: what its record, read back from the archives, says of it."""
    scratch = Scratch(spark, "warc")
    written = scratch.table("manifest", write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch.path("archives")))
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return read_archives(written).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"))


OP5_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM f
"""
