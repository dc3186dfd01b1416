"""WARC archives: a distributed writer and a splittable reader.

Writing: every page becomes one WARC record, compressed as a gzip member of its own. Of pages with
equal payloads of at least ``REVISIT_BYTES`` the one with the largest page_id is a response and the
others are revisits that refer to it. Members go out through Spark's own text sink, so commit, retry
and file system are Spark's: the line separator is one zero byte, which is the last byte of a member
(the high byte of its length) below 16 MiB; a larger one is followed by an empty member.

Reading: files are cut into byte ranges, dealt over tasks. A range is scanned for the gzip magic; a
candidate is tried by decoding its first bytes (a record starts with ``WARC/``); the range owns the records
that start inside, and is read past its end for the last. After a record the next must follow at once.
Digests of response payloads are computed anew and must match their headers.

Defined cases: null html is an empty payload; null page_id and url stay null, and a null page_id's long
payload revisits an equal one that has an id; rows of one page_id and
payload are all responses if theirs is the largest page_id; an empty table gives no records; extra
columns are not read. Payloads are kept whole whatever their length. A record that is cut off or does
not decode, and bytes between records, raise a ValueError that names file and place; with
``errors="skip"`` the scan goes on at the next record instead.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspool.llm import common

REVISIT_BYTES, RANGE_BYTES = 1000, 8 << 20
#: Bytes given to the decoder at once, and to try a candidate; tasks at most, beyond which one takes more ranges.
FEED, HEAD, MOST_TASKS = 1 << 16, 512, 20_000
MAGIC, PREFIX = b"\x1f\x8b\x08", "urn:x-page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One record, uncompressed."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=~-._')}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: <{PREFIX}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes an archive of pages (page_id, url, html) as files under path."""
    common.ship(pages.sparkSession)
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("digest"))
    ids = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest")
    last = ids.groupBy("digest").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "last")
    again = ids.join(last, "digest").where("page_id < last or page_id is null").select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("last").alias("refers_to")).distinct()
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["_id"]) & (rows["digest"] == again["_digest"]), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                out = []
                for row in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns), strict=True):
                    packed = _member(record(*row, date))
                    if packed[-1]:
                        packed += _member(b"")
                    out.append(packed[:-1])
                yield pa.record_batch([pa.array(out, pa.binary())], ["member"])

    members = rows.mapInArrow(run, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


def ranges(spark: SparkSession, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """(file, start, end) of all byte ranges of the files under path, dealt over tasks; Spark lists the files and reads none."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length").where("length > 0")
    total = files.agg(F.sum("length")).first()[0] or 0
    cuts = files.select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("start"))
    tasks = min(MOST_TASKS, max(1, 2 * total // size))
    return cuts.select("file", "start", F.least(F.col("start") + size, "length").alias("end")).repartition(tasks, "file", "start")


class _Reader:
    """Bytes of one file by offset, local or through Arrow's file systems."""

    def __init__(self, uri: str):
        parts = urlsplit(uri)
        if parts.scheme in ("", "file"):
            self.file = open(unquote(parts.path), "rb")  # noqa: SIM115
        else:
            from pyarrow import fs

            system, at = fs.FileSystem.from_uri(uri)
            self.file = system.open_input_file(at)

    def read(self, at: int, many: int) -> bytes:
        self.file.seek(at)
        return self.file.read(many)


class Damaged(ValueError):
    """A record is cut off or does not decode, or bytes that are no record follow one."""


def _unpack(reader: _Reader, start: int, data: memoryview, at: int, sure: bool) -> tuple[bytes, int] | None:
    """(member's content, end) of the member at ``at`` of data, which begins at ``start`` of the file.

    None if no record starts there; where ``sure`` says that a member must, Damaged. The end is relative to data.
    """
    def no_record(why: str) -> None:
        if sure:
            raise Damaged(f"record at byte {start + begin} {why}")

    begin, tester = at, zlib.decompressobj(31)
    first = data[at : at + HEAD]
    if len(first) < HEAD:
        first = bytes(first) + reader.read(start + at + len(first), HEAD - len(first))
    try:
        head = tester.decompress(first, 5)
    except zlib.error:
        return no_record("does not decode")
    if head != b"WARC/" and not (tester.eof and not head):
        return no_record("is cut off" if len(head) < 5 and not tester.eof else "is none")
    opener, out = zlib.decompressobj(31), []
    while not opener.eof:
        chunk = data[at : at + FEED] if at < len(data) else reader.read(start + at, FEED)
        if not chunk:
            raise Damaged(f"record at byte {start + begin} is cut off")
        try:
            out.append(opener.decompress(chunk))
        except zlib.error as e:
            raise Damaged(f"record at byte {start + begin} does not decode: {e}") from e
        at += len(chunk)
    return b"".join(out), at - len(opener.unused_data)


def parse(data: bytes) -> dict:
    """The fields of a record; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(PREFIX)) else None
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['warc-record-id']}: payload differs from its header")
    url = fields.get("warc-target-uri")
    return {"page_id": number(fields["warc-record-id"]), "url": None if url is None else unquote(url), "payload_bytes": length, "payload_digest": digest, "record_type": kind,
            "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": payload if kind == "response" else None}


def scan(uri: str, start: int, end: int, errors: str = "raise") -> Iterator[dict]:
    """The records of a file that start in [start, end); each byte is looked at once."""
    reader = _Reader(uri)
    data = reader.read(start, end - start + len(MAGIC) - 1)
    view, most = memoryview(data), end - start
    at, sure = (data.find(MAGIC), False) if start else (0, True)
    while 0 <= at < most:
        try:
            found = _unpack(reader, start, view, at, sure)
            if found:
                content, after = found
                if content:
                    yield parse(content)
                behind = data[after : after + len(MAGIC)] if after + len(MAGIC) <= len(data) else reader.read(start + after, len(MAGIC))
                if behind and behind != MAGIC:
                    raise Damaged(f"no record at byte {start + after}")
                at, sure = after, True
                continue
        except ValueError as e:
            if errors != "skip":
                raise ValueError(f"{uri}: {e}") from e
        at, sure = data.find(MAGIC, at + 1), False


def read(spark: SparkSession, path: str, size: int = RANGE_BYTES, payload: bool = True, errors: str = "raise") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload (null: revisit) if asked for, of all records under path."""
    common.ship(spark)
    frame = ranges(spark, path, size)
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payload
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for r in scan(row["file"], row["start"], row["end"], errors):
                    held.append({k: r[k] for k in schema.names})
                    size += r["payload_bytes"] if payload else 100
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    return frame.mapInArrow(run, kinds)
