"""WARC archives: a writer on Spark's text sink and a salvage reader on its binary source.

Writing. A record is one string value, header lines and block, and the sink's line separator is the CR LF CR LF that ends a
record, so that any store that Spark reaches can hold the archives and no payload passes through Python. Of records with equal
payloads of at least `least` bytes, the one with the smallest page_id is a response, the others revisit it and carry headers only.
Records are written by classes of size, so that no archive exceeds ARCHIVE_BYTES unless it holds a single record.

Reading. `salvage` parses records of plain archives and of archives with one gzip member a record. A record counts if its version
line, headers, Content-Length, closing CR LF CR LF and digests hold. After a failed check it looks for the next version line
(or gzip member that unpacks to one), goes on from there, and logs the bytes between as a quarantined gap. `gaps` is that log;
`round_trip` fails if its own archives have a gap or give back another number of records than pages were written.

Null html is an empty payload; a null url or page_id leaves its header out or empty. Line breaks in urls are percent-encoded, and
neither urls nor payloads have a greatest length below that of a string in Spark. Of rows with equal payloads and one page_id
(repeated rows, or other urls) one is the response, that with the smallest url, and the others revisit their own page_id. A null
page_id comes after all others. Columns other than page_id, url and html are ignored. An empty table gives archives without
records and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fits_broadcast, materialize, prepare, scratch_dir

VERSION = "WARC/1.1"
END = "\r\n\r\n"
LEAST = 100
#: No archive of more than one record is longer; a reader holds one archive in memory.
ARCHIVE_BYTES = 128 << 20
#: Longest record of each class of size.
CLASSES = (32 << 10, 1 << 20, 16 << 20, 1 << 40)
#: Bytes of headers without the url, at most.
HEAD = 700
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_GZIP = b"\x1f\x8b\x08"
#: Where headers end, or the version line of the next record shows that they do not.
_HEAD = re.compile(rb"\r\n\r\n|\r\nWARC/1\.[01]\r\n")


def classified(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, size, digest, first: the page_id of the record that has the payload, and copy: whether this row is to revisit it."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    big = rows.where(F.col("size") >= least).select("page_id", "digest")
    # Copies only: what occurs once is a response and needs no join partner.
    first = materialize(big.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    # A small table goes to the payloads; beyond that payloads are dealt by digest, and adaptive execution splits frequent ones.
    first = F.broadcast(first) if fits_broadcast(first.count(), 160) else first
    rows = rows.join(first.withColumn("many", F.lit(True)), "digest", "left")
    lead = F.col("many") & F.col("page_id").eqNullSafe(F.col("first"))
    # Rows that share the response's page_id and payload: one of them is to stay a response.
    twice = materialize(big.join(first, "digest").where(F.col("page_id").eqNullSafe(F.col("first"))).groupBy("digest").count().where("count > 1").select("digest", F.lit(True).alias("twice")))
    names = ["page_id", "url", "payload", "size", "digest", "first"]
    if twice.isEmpty():
        return rows.select(*names, F.coalesce(F.col("many") & ~lead, F.lit(False)).alias("copy"))
    rows = rows.join(F.broadcast(twice) if fits_broadcast(twice.count(), 160) else twice, "digest", "left").withColumn("tied", F.coalesce(F.col("twice") & lead, F.lit(False)))
    plain = rows.where("NOT tied").select(*names, F.coalesce(F.col("many") & ~lead, F.lit(False)).alias("copy"))
    # Equal rows meet within partitions first; payloads travel once for each partition and revisits carry none.
    tied = rows.where("tied").groupBy("digest", "page_id", "first", "size", "url", F.spark_partition_id().alias("part")).agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    order = F.struct(F.col("url").isNull().alias("none"), "url", "part")
    chosen = tied.groupBy("digest").agg(F.min(order).alias("best"))
    tied = tied.join(chosen, "digest").withColumn("own", (order == F.col("best")).cast("int"))
    flags = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: i > F.col("own"))
    return plain.unionByName(tied.select(*names, F.explode(flags).alias("copy")))


def record_text(rows: DataFrame) -> DataFrame:
    """One string for each row of classified(): a whole record but for the CR LF CR LF after it."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    block = F.when(F.col("copy"), http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: "), F.when(F.col("copy"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(f">\r\nWARC-Date: {DATE}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("size"),
        F.when(F.col("copy"), F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.coalesce(F.col("first").cast("string"), F.lit("")), F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write(pages: DataFrame, path: str | None = None, least: int = LEAST) -> str:
    """Writes one record for each page; returns the folder of archives."""
    path = path or scratch_dir(pages.sparkSession)
    rows = classified(pages, least)

    def kind(size):
        length = size + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + HEAD
        return F.lit(len(CLASSES)) - reduce(lambda a, b: a + b, [(length <= x).cast("int") for x in CLASSES])

    sizes = pages.groupBy(kind(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).alias("k")).count()
    there = sorted(r["k"] for r in sizes.collect()) or [0]
    for k in there:
        longest = CLASSES[k]
        files = record_text(rows.where(kind(F.col("size")) == k)).write.mode("overwrite" if k == there[0] else "append").option("maxRecordsPerFile", max(1, ARCHIVE_BYTES // longest))
        files.option("lineSep", END).option("compression", "none").text(path)
    return path


def gzip_member(record: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(record) + c.flush()


def _parse(data: bytes, at: int) -> tuple[dict[str, str], int, int] | str:
    """Headers, start and end of the block of the record at a version line, or what is wrong with it."""
    stop = _HEAD.search(data, at + len(VERSION))
    if not stop or stop.group() != b"\r\n\r\n":
        return "headers without end"
    head = stop.start()
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return "bad header line"
        fields[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", fields.get("content-length", "")):
        return "bad Content-Length"
    end = head + 4 + int(fields["content-length"])
    if end > len(data):
        return "block cut off"
    if data[end : end + 4] != b"\r\n\r\n":
        return "no CR LF CR LF after the block"
    if "warc-type" not in fields or "warc-record-id" not in fields:
        return "a required header is missing"
    return fields, head + 4, end


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    if "application/http" in fields.get("content-type", ""):
        return block.partition(b"\r\n\r\n")[2]
    return block


def _digests(fields: dict[str, str], block: bytes) -> str:
    for name, what in (("warc-block-digest", block), ("warc-payload-digest", None)):
        kind, _, told = fields.get(name, "").partition(":")
        if kind == "sha256" and not (what is None and fields["warc-type"] == "revisit"):
            if hashlib.sha256(payload_of(fields, block) if what is None else what).hexdigest() != told.lower():
                return f"{name} differs"
    return ""


def _member(data: bytes, at: int) -> tuple[bytes, int] | str:
    """What the gzip member at a place unpacks to and where it ends, or what is wrong with it. Reads no further than twice the member."""
    d, view, parts, step = zlib.decompressobj(31), memoryview(data), [], 4096
    try:
        while at < len(data) and not d.eof:
            parts.append(d.decompress(view[at : at + step]))
            at, step = min(at + step, len(data)), min(2 * step, 1 << 20)
    except zlib.error as e:
        return f"gzip: {e}"
    return (b"".join(parts), at - len(d.unused_data)) if d.eof else "gzip member cut off"


def _places(data: bytes, members: bool):
    """A function that gives the next version line or member after a place; places ascend, and each byte is searched once for each kind."""
    known = [-1, -1]

    def after(at: int) -> int:
        if known[0] <= at:
            line = _LINE.search(data, at + 1)
            known[0] = line.start() if line else len(data)
        if members and known[1] <= at:
            found = data.find(_GZIP, at + 1)
            known[1] = found if found >= 0 else len(data)
        return min(known) if members else known[0]

    return after


def salvage(data: bytes, members: bool = True) -> Iterator[tuple[str, object, object, object]]:
    """("record", offset, headers, block) for each sound record and ("gap", start, end, reason) for each run of bytes given up. members: whether gzip is looked for."""
    at, gap, why, after = 0, None, "", _places(data, members)
    while at < len(data):
        found: list = []
        if members and data.startswith(_GZIP, at):
            got = _member(data, at)
            bad = got if isinstance(got, str) else ""
            if not bad:
                inside = list(salvage(got[0], False))
                found = [x for x in inside if x[0] == "record"]
                bad = "" if found and len(found) == len(inside) else next((x[3] for x in inside if x[0] == "gap"), "empty member")
                end = got[1]
        elif _LINE.match(data, at):
            got = _parse(data, at)
            bad = got if isinstance(got, str) else _digests(got[0], data[got[1] : got[2]])
            if not bad:
                found, end = [("record", at, got[0], data[got[1] : got[2]])], got[2] + 4
        else:
            bad = "no version line or member"
        if found:
            if gap is not None:
                yield "gap", gap, at, why
                gap = None
            if bad:
                yield "gap", at, end, f"part of a member: {bad}"
            for x in found:
                yield "record", at, x[2], x[3]
            at = end
            continue
        if gap is None:
            gap, why = at, bad
        at = after(at)
    if gap is not None:
        yield "gap", gap, len(data), why


SCHEMA = "kind string, file string, at long, until long, reason string, record_type string, record_id string, refers_to string, url string, payload_bytes long, payload_digest string, payload binary"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Rows of kind record (what it holds; payload_bytes and payload_digest of the full payload) and of kind gap (at, until, reason)."""
    prepare(spark)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = dict(zip(names, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True))

    def run(batches):
        for b in batches:
            for file, content in zip(b.column("path"), b.column("content"), strict=True):
                rows = []
                for kind, at, x, y in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append({"kind": kind, "file": file.as_py(), "at": at, "until": x, "reason": y})
                        continue
                    body = payload_of(x, y)
                    full = x["warc-type"] != "revisit"
                    rows.append({
                        "kind": kind, "file": file.as_py(), "at": at, "record_type": x["warc-type"], "record_id": x["warc-record-id"].strip("<>"),
                        "refers_to": x.get("warc-refers-to", "").strip("<>") or None, "url": x.get("warc-target-uri"),
                        "payload_bytes": len(body) if full else int(x.get("x-payload-length", "0")),
                        "payload_digest": hashlib.sha256(body).hexdigest() if full else x.get("warc-payload-digest", "").removeprefix("sha256:"),
                        "payload": body if payloads and full else None,
                    })
                for s in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows[s : s + 1000]], types[n]) for n in names], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def gaps(read_: DataFrame) -> DataFrame:
    """The log of quarantined bytes of read(): file, at, until, reason."""
    return read_.where("kind = 'gap'").select("file", "at", "until", "reason")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes the pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to. Fails if a record is missing or bytes are quarantined."""
    page = lambda c: F.expr(f"try_cast(substring_index({c}, ':', -1) AS BIGINT)")
    got = materialize(read(pages.sparkSession, write(pages, least=least)).drop("payload", "url"))
    records, lost = got.agg(F.count_if(F.col("kind") == "record"), F.count_if(F.col("kind") == "gap")).first()
    if lost or records != (written := pages.count()):
        raise ValueError(f"{records} records read, {lost} gaps: {gaps(got).limit(5).collect()}" + ("" if lost else f", {written} pages written"))
    return got.where("kind = 'record'").select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
