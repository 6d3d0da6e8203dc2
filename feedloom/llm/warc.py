"""WARC archives: one gzip member for each record, revisit records for repeated payloads, and a sequential reader.

Records are written by Spark's own file writer, so commits, retries and every file system Spark knows work as for any
other table, and read from ``binaryFile`` rows. An archive is as large as one partition of the input.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom.session import stage

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
CHUNK = 1 << 16
BATCH_BYTES = 8 << 20
#: Below this size the last byte of a gzip member, the top byte of its length, is zero.
SHORT = 1 << 24
EMPTY_MEMBER = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)

RECORD_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, "
    "payload_digest string, verified boolean"
)


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each ten hexadecimal digits are eight base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), BASE32_HEX, BASE32)


def plan_records(pages: DataFrame, *, key: str, uri: str, text: str, least_bytes: int = 0) -> DataFrame:
    """One row for each page: what its record will hold and whether it repeats another page's payload.

    Of pages with equal payloads of at least ``least_bytes`` bytes, those with the largest key are responses and the
    others revisit it. A null text is an empty payload. A null key is smaller than any other; pages that share the
    largest key are all responses. Only payloads that occur more than once take part in a join, so a table without
    repeats isn't shuffled. A payload may have any length that fits into memory; an empty table has no records.
    """
    records = pages.select(
        F.col(key).alias("key"), F.col(uri).alias("uri"), F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("payload")
    ).select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"))
    thin = records.select("key", "payload_bytes", "payload_digest").where(F.col("payload_bytes") >= least_bytes)
    repeated = stage(
        thin.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("key").alias("first_key"))
        .where("n > 1").select("payload_digest", "first_key"),
        "warc-repeated",
    )
    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("first_key").isNotNull() & ~F.col("key").eqNullSafe(F.col("first_key"))
    return records.join(repeated, "payload_digest", "left").select(
        "key", "uri", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_key")).alias("refers_to"),
    )


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(text: str) -> str:
    """Control characters and spaces can't stand in a header line; they are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _member(fields: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    data = b"".join((b"WARC/1.1\r\n", head.encode(), b"Content-Length: %d\r\n\r\n" % len(block), block, b"\r\n\r\n"))
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    member = packer.compress(data) + packer.flush()
    return member if len(data) < SHORT else member + EMPTY_MEMBER


def _record(row: dict, date: str, level: int) -> bytes:
    payload = row["payload"]
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:key:{row['key']}>"), ("WARC-Date", date)]
    if row["uri"] is not None:
        fields.append(("WARC-Target-URI", _uri(row["uri"])))
    block = HTTP_HEAD % len(payload)
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:key:{row['refers_to']}>")]
    else:
        block += payload
    fields += [
        ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("WARC-Block-Digest", f"sha1:{_digest(block)}"),
        ("X-Payload-Length", row["payload_bytes"]), ("Content-Type", "application/http; msgtype=response"),
    ]
    return _member(fields, block, level)


def write_archives(records: DataFrame, path: str, *, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> None:
    """Write the rows of ``plan_records`` as archives, one file for each partition.

    Spark's text writer ends every row with a line separator. The separator here is the zero byte that ends every gzip
    member, and the row is the member without it, so a file is exactly its members in sequence.
    """

    def members(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pylist()
                yield pa.RecordBatch.from_pydict({"member": [_record(r, date, level)[:-1] for r in rows]}, pa.schema([("member", pa.binary())]))

    (
        records.mapInArrow(members, "member binary").select(F.col("member").cast("string"))
        .write.option("lineSep", "\x00").option("compression", "none").text(path)
    )


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines[1:])}


def iterate_records(content):
    """Fields and block of each record of one archive, decompressing a chunk at a time, in file order.

    Every gzip member must hold one record, framed by its content length; empty members are skipped.
    """
    at, view = 0, memoryview(content)
    while at < len(view):
        unpack, data, need, fields, start = zlib.decompressobj(31), bytearray(), None, None, at
        while not unpack.eof:
            piece = view[at:at + CHUNK]
            if not len(piece):
                raise ValueError(f"the member at {start} is cut off")
            data += unpack.decompress(piece)
            at += len(piece) - len(unpack.unused_data)
            if need is None and (end := data.find(b"\r\n\r\n")) >= 0:
                fields = _fields(bytes(data[:end]))
                need = end + 4, end + 4 + int(fields["content-length"])
        if not data:
            continue
        if need is None or len(data) != need[1] + 4 or data[need[1]:] != b"\r\n\r\n":
            raise ValueError(f"the member at {start} doesn't hold one record of its content length")
        yield fields, bytes(data[need[0]:need[1]])


def _read(fields: dict[str, str], block: bytes, payloads: bool) -> dict:
    end = block.find(b"\r\n\r\n")
    payload = block[end + 4:] if end >= 0 else block
    kind, stated = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    whole = kind != "revisit"
    digest = _digest(payload) if whole else stated
    good = fields["warc-block-digest"] == f"sha1:{_digest(block)}" and digest == stated
    length = int(fields["x-payload-length"])
    return {
        "record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
        "payload": payload if whole and payloads else None, "payload_bytes": len(payload) if whole else length,
        "payload_digest": digest, "verified": good and (not whole or length == len(payload)),
    }


def read_archives(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives under ``path``.

    Block and payload digests are recomputed: ``verified`` tells whether they and the lengths agree. Broken framing
    raises an error. A folder without records gives an empty table. ``payloads=False`` leaves the payloads out once they are checked.
    """
    schema = pa.schema([
        ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
        ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("verified", pa.bool_()),
    ])

    def records(batches):
        rows, held = [], 0
        for batch in batches:
            for value in batch.column(0):
                for fields, block in iterate_records(value.as_buffer()):
                    rows.append(_read(fields, block, payloads))
                    held += len(block) if payloads else 300
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(records, RECORD_SCHEMA)


def key_of(record_id: Column) -> Column:
    """The page's key from a record id; null for a page without one."""
    return F.substring_index(record_id, ":", -1).try_cast("long")
