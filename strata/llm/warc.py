"""WARC archives: writer and sequential reader.

Writing: each row becomes one WARC/1.1 record in a gzip member of its own.
Of rows with equal payloads of at least ``min_revisit`` bytes the one with the
smallest id is a ``response`` and the others are ``revisit`` records that
refer to it.  Spark's text sink writes the members: every gzip member ends in
the high byte of its length, which is zero below 16 MiB, so the sink's line
separator (one zero byte) is exactly that last byte.  A longer record is
followed by an empty gzip member, which ends in a zero byte too.  So archives
go through Spark's commit protocol to any file system Spark can write.

Reading: members are inflated piece by piece, a record's header is taken up to
its blank line, its block is framed by Content-Length, and block and payload
digests are recomputed and compared.

Defined results.  Null payload: empty.  Null id: written as ``null`` and read
back as null; it never is the one referred to unless all copies have null ids,
which then all stay responses.  Repeated rows with the smallest id: all are
responses.  Null url: no target line.  Empty table: no records.  Columns beyond
the three named ones are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, scratch, store, table

CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = zlib.compress(b"", wbits=31)
ID = "<urn:strata:page:{}>"

READ_SCHEMA = "archive string, position long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, error string"
_READ = pa.schema([("archive", pa.string()), ("position", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def member(kind: str, record_id, url, payload: bytes, digest: str, refers_to, date: str, level: int) -> bytes:
    """One WARC record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {ID.format('null' if record_id is None else record_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {ID.format(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packed = zlib.compress(record, level, wbits=31)
    return packed if packed[-1] == 0 else packed + EMPTY_MEMBER


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 100, date: str = "2024-01-01T00:00:00Z", level: int = 5) -> None:
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    # the few digests that occur again; counted before the shuffle, so a hot payload is one row of each task
    first = (
        rows.filter(F.octet_length("payload") >= min_revisit).groupBy(F.col("digest").alias("again"))
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    rows = rows.join(first, rows.digest == first.again, "left").withColumn(
        "first", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    )
    out = pa.schema([("record", pa.binary())])

    def records(batches):
        for b in batches:
            cols = {n: b.column(n) for n in ("id", "url", "payload", "digest", "first")}
            done, size = [], 0
            for i in range(b.num_rows):
                x = {n: c[i].as_py() for n, c in cols.items()}
                kind = "response" if x["first"] is None else "revisit"
                done.append(member(kind, x["id"], x["url"], x["payload"], x["digest"], x["first"], date, level)[:-1])
                size += len(done[-1])
                if size > 8 << 20:
                    yield batch(out, done)
                    done, size = [], 0
            yield batch(out, done)

    (rows.select("id", "url", "payload", "digest", "first").mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", "\x00").option("compression", "none").text(path))


class Corrupt(ValueError):
    pass


def _inflated(data: memoryview, at: int, state: list):
    """Inflated pieces of the gzip member at ``at``; ``state[0]`` becomes the position behind it."""
    z = zlib.decompressobj(wbits=31)
    while not z.eof:
        piece = data[at : at + CHUNK]
        if not piece:
            raise Corrupt("the archive ends inside a member")
        try:
            got = z.decompress(piece)
        except zlib.error as e:
            raise Corrupt(str(e)) from e
        at += len(piece)
        if got:
            yield got
    state[0] = at - len(z.unused_data)


def _record(pieces, with_payload: bool) -> dict | None:
    """Parse and verify one record from its inflated pieces; None for an empty member."""
    head = b""
    for piece in pieces:
        head += piece
        if b"\r\n\r\n" in head:
            break
    if not head:
        return None
    head, blank, rest = head.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"WARC/"):
        raise Corrupt("no record header")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise Corrupt("no content length")
    length = int(fields["content-length"])
    whole, body = hashlib.sha256(), hashlib.sha256()
    kept, seen, http, n_payload, tail = [], 0, b"", 0, 0
    in_http = fields.get("content-type", "").startswith("application/http")

    def feed(data: bytes) -> None:
        nonlocal in_http, http, n_payload
        if in_http:
            http += data
            if b"\r\n\r\n" not in http:
                return
            data, in_http = http.partition(b"\r\n\r\n")[2], False
        body.update(data)
        n_payload += len(data)
        if with_payload:
            kept.append(data)

    def take(piece: bytes) -> None:
        nonlocal seen, tail
        part = piece[: length - seen]
        seen += len(part)
        tail += len(piece) - len(part)
        whole.update(part)
        feed(part)

    take(rest)
    for piece in pieces:
        take(piece)
    if seen != length or tail != 4:
        raise Corrupt(f"Content-Length is {length}; the block has {seen} bytes and {tail} follow")
    said, block = fields.get("warc-payload-digest"), fields.get("warc-block-digest")
    if block and block != f"sha256:{whole.hexdigest()}":
        raise Corrupt("block digest differs")
    kind = fields.get("warc-type")
    if kind == "response" and said and said != f"sha256:{body.hexdigest()}":
        raise Corrupt("payload digest differs")
    url = fields.get("warc-target-uri")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": url, "refers_to": fields.get("warc-refers-to"), "payload_digest": (said or "").removeprefix("sha256:"), "payload_bytes": n_payload if kind == "response" else None, "payload": b"".join(kept) if with_payload and kind == "response" else None}


def archive_records(data, with_payload: bool = False):
    """(position, record or None, error) of each member of one archive.  After an error
    reading goes on at the next member header, if the archive has one."""
    data, state = memoryview(data), [0]
    while state[0] < len(data):
        at = state[0]
        try:
            pieces = _inflated(data, at, state)
            record = _record(pieces, with_payload)
            for _ in pieces:
                pass
            if record is not None:
                yield at, record, None
        except Corrupt as e:
            yield at, None, str(e)
            following = bytes(data[at + 1 :]).find(b"\x1f\x8b\x08")
            if following < 0:
                return
            state[0] = at + 1 + following


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of all archives under ``path``.  One task reads an archive from front to back;
    a damaged record gives a row with ``error`` set.  Archives must fit a task (1 GB or less)."""

    def parse(batches):
        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column("path")[i].as_py(), b.column("content")[i].as_buffer()
                rows, size = [], 0
                for at, r, error in archive_records(data, with_payload):
                    r = r or {}
                    rows.append({"archive": name, "position": at, **r, "error": error})
                    size += 200 + len(r.get("payload") or b"")
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_READ)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, READ_SCHEMA)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives, read the archives back, resolve revisits to their responses."""
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"page:(-?\d+)>", 1).try_cast("long")
    back = read_warc(spark, path).select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"), "error"
    )
    back = store(back, "warc-read")
    bad = back.filter("error is not null").limit(1).collect()
    if bad:
        raise ValueError(f"damaged record: {bad[0].error}")
    target = (
        back.filter("record_type = 'response'").join(back.filter("record_type = 'revisit'").select(F.col("refers_to").alias("page_id")).distinct(), "page_id", "left_semi")
        .groupBy(F.col("page_id").alias("target_id"), F.col("payload_digest").alias("target_digest")).agg(F.max("payload_bytes").alias("target_bytes"))
    )
    joined = back.join(target, (back.refers_to == target.target_id) & (back.payload_digest == target.target_digest), "left")
    return joined.select("page_id", F.coalesce("payload_bytes", "target_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


QUERIES = {"op1_warc": op1_warc}
ORACLE = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
     d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
     f AS (SELECT payload_digest, min(page_id) AS lowest FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.lowest IS NOT NULL AND f.lowest IS DISTINCT FROM d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.lowest IS DISTINCT FROM d.page_id THEN f.lowest END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)"""
}
