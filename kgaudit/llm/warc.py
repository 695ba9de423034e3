"""WARC archives: a writer with revisit records and a reader that splits files at any byte.

Writing. Each page is one record in a gzip member of its own. Pages with equal payloads of some size are stored once:
the one with the smallest id is the response, the others are revisits that refer to it and carry its HTTP header only.
Spark's own text writer puts the members into files one after another, so task commit, retries and lost executors are
its business and any file system that Spark reaches will do. The writer ends each row with one fixed byte; that byte is
the last one of the member (the high byte of its length, which is zero; a member it isn't zero for gets an empty member
behind it).

Reading. Files are cut into byte ranges. A task searches its range for the gzip magic, tries a candidate by inflating
it, and takes it for a member only if a WARC header comes out. It owns the records that start in its range and reads
past the range's end to finish the last. From a valid member's end it goes on at the next byte, so chance magic inside
compressed data is not even tried; where a range starts amid a member, chance magic fails the test. The writer never
stores a payload verbatim in a way that would pass it.

Defined cases: a null payload is empty; a null url becomes an empty target. Equal ids with equal payloads are all
responses if the id is the smallest. A null id sorts last. No pages make an archive without records. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgaudit.llm.memory import lean
from kgaudit.session import shared_dir, width

MAGIC = b"\x1f\x8b\x08"
_EMPTY_MEMBER = bytes([31, 139, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0]) + bytes(8)
_DATE = "2024-01-01T00:00:00Z"  # fixed, so that writing twice gives the same bytes
RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, file string, offset long"


def _gzip(raw: bytes, level: int = 6) -> bytes:
    """One gzip member that ends with a zero byte and inside which no other record can be taken for one."""
    for lv, strategy in ((level, zlib.Z_DEFAULT_STRATEGY), (1, zlib.Z_HUFFMAN_ONLY), (9, zlib.Z_FIXED)):
        c = zlib.compressobj(lv, zlib.DEFLATED, 31, 9, strategy)
        out = c.compress(raw) + c.flush()
        at = out.find(MAGIC, 1)
        while at >= 0 and not _starts_record(out[at:]):
            at = out.find(MAGIC, at + 1)
        if at < 0:
            break
    return out if out[-1] == 0 else out + _EMPTY_MEMBER


def _starts_record(data: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data, 7)[:7] == b"WARC/1."
    except zlib.error:
        return False


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write(pages: DataFrame, path: str | None = None, least_bytes: int = 100, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> str:
    """Writes the archives and returns their folder (a new one in the shared folder, if none is given)."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # first ids of payloads that occur more than once: counted apart from the payloads, with partial sums for hot ones
    first = rows.filter(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    rows = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", F.expr("if(page_id > first or page_id is null, first, null)").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            yield pa.RecordBatch.from_arrays([pa.array([_gzip(_record(*x))[:-1] for x in zip(*cols, strict=True)], pa.binary())], names=["member"])

    # a cast from binary to string keeps the bytes as they are, and the text writer writes them so
    rows.mapInArrow(lean(run), "member binary").select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)
    return path


def _open(path: str) -> pa.NativeFile:
    """A file of the shared store, for reading at any place."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(path)
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    files, inner = fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)
    return files.open_input_file(inner)


def _parse(raw: bytes) -> dict | None:
    head, cut, body = raw.partition(b"\r\n\r\n")
    if not cut or not head.startswith(b"WARC/1."):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    body = body[: int(fields.get("content-length", 0))]
    number = lambda x: int(x.strip("<>").rpartition(":")[2]) if x and x.strip("<>").rpartition(":")[2] else None
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").rpartition(":")[2]
    http, _, payload = body.partition(b"\r\n\r\n")
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if digest and digest != found:
            raise ValueError(f"record {fields.get('warc-record-id')}: its payload has another digest")
        size, digest = len(payload), found
    else:
        payload = None
        size = next((int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
    return {"page_id": number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number(fields.get("warc-refers-to")), "payload": payload, "payload_bytes": size, "payload_digest": digest}


def scan_range(f: pa.NativeFile, start: int, end: int, step: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated record) of the members that start in [start, end)."""
    total, base, data = f.size(), start, b""

    def fill(upto: int) -> None:
        nonlocal data
        f.seek(base + len(data))
        data += f.read(min(total, upto) - base - len(data)) if min(total, upto) > base + len(data) else b""

    at = start
    while at < end:
        if at - base > step:  # what lies behind is done with
            data, base = data[at - base :], at
        if base + len(data) < min(at + step, total):
            fill(at + step)
        hit = data.find(MAGIC, at - base)
        if hit < 0:
            if base + len(data) >= min(end + 2, total):
                return
            at = max(at, base + len(data) - 2)  # magic may lie across the border
            fill(base + len(data) + step)
            continue
        at = base + hit
        if at >= end:
            return
        inflate, out, fed, ok = zlib.decompressobj(31), [], 0, True
        try:
            while not inflate.eof:
                have = data[at - base + fed : at - base + fed + step]
                if not have:
                    fill(base + len(data) + step)
                    have = data[at - base + fed : at - base + fed + step]
                    if not have:
                        ok = False
                        break
                out.append(inflate.decompress(have))
                fed += len(have)
                if sum(map(len, out[:8])) >= 7 and not b"".join(out[:8]).startswith(b"WARC/1."):
                    ok = False
                    break
        except zlib.error:
            ok = False
        raw = b"".join(out) if ok else b""
        if ok and raw.startswith(b"WARC/1."):
            yield at, raw
            at += fed - len(inflate.unused_data)
        else:
            at += 1


def read(spark: SparkSession, path: str, range_bytes: int = 8 << 20) -> DataFrame:
    """The records of all archives in a folder; refers_to is the page that a revisit stands for."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size"))  # lists; contents aren't read
    ranges = files.filter("size > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"), "size")
    ranges = ranges.repartition(max(width(spark), 1), "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("file", pa.string()), ("offset", pa.int64())])
        for b in batches:
            for name, start, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows, held = [], 0
                with _open(name) as f:
                    for at, raw in scan_range(f, start, min(start + range_bytes, size)):
                        if (x := _parse(raw)) is None:
                            continue
                        rows.append(x | {"file": name, "offset": at})
                        held += len(raw)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return ranges.mapInArrow(lean(run), RECORDS)


def archive_round_trip(pages: DataFrame, **kw) -> DataFrame:
    """Writes the pages, reads the archives back, and gives each record's digest columns."""
    return read(pages.sparkSession, write(pages, **kw)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND (page_id > first OR page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND (page_id > first OR page_id IS NULL) THEN first END AS refers_to FROM q
"""
