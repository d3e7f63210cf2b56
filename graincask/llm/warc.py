"""WARC archives with an index: records are gzip members whose offset, length, URL and digest are written first-class,
and a reader that sorts the wanted records by place and coalesces neighbouring byte ranges into single reads.

Of records with equal payloads of at least min_revisit_bytes, the one with the smallest id is a response and the
others are revisits of it. Writers make one archive per task under a name of its own in the shared folder; the index,
which is the tasks' output, names only archives of attempts that succeeded, so a lost executor leaves at worst an
unnamed file. No page goes through a shuffle: only digests are aggregated, and what a part's pages refer to is told in place (see inplace).

Defined results: a null payload is an empty one. A null url is written as an empty target. Ids that repeat with the
smallest id's payload are responses, each; a null id is a response unless a smaller id has the payload, nulls being larger
than all ids. Ids repeated with other payloads are records of their own. An empty table gives an empty index and no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graincask.llm import inplace
from graincask.llm.common import n_tasks, settle, table
from graincask.llm.inplace import filesystem as _filesystem

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: A writer starts another archive after so many compressed bytes.
ARCHIVE_BYTES = 1 << 30
#: Ranges in one archive that lie at most so far apart are read at once, up to so many bytes.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20

INDEX = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"


class Resolved(NamedTuple):
    """Pages (part, page_id, url, payload, digest as hexadecimal SHA-1 and as three numbers), and where the first id of digests of several pages is filed."""

    pages: inplace.Pinned
    filed: str
    min_revisit_bytes: int


_DIGEST = ("d0", "d1", "d2")


def resolve(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0) -> Resolved:
    """Finds the smallest id of each payload that several pages have."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    number = lambda start, length: F.conv(F.substring("digest", start, length), 16, 10).cast("long")
    given = inplace.pinned(rows.withColumns(dict(zip(_DIGEST, (number(1, 15), number(16, 15), number(31, 10)), strict=True))))
    large = given.rows.filter(F.octet_length("payload") >= min_revisit_bytes)
    by_part = settle(large.groupBy("part", *_DIGEST).agg(F.min("page_id").alias("low"), F.count(F.lit(1)).alias("n")))
    first = by_part.groupBy(*_DIGEST).agg(F.min("low").alias("first_id"), F.sum("n").alias("n")).filter("n > 1 AND first_id IS NOT NULL").drop("n")
    return Resolved(given, inplace.file_away(by_part.join(first, list(_DIGEST)).select("part", *_DIGEST, "first_id")), min_revisit_bytes)


def records(batches: Iterator[pa.RecordBatch], filed: str, least: int) -> Iterator[dict]:
    """The records of a task's pages, one after another: page_id, url, payload, digest (base32), record_type, refers_to."""
    at, told = None, None
    for part, batch in inplace.by_part(batches, 256):
        if part != at:
            at, told = part, inplace.Told(filed, part, *_DIGEST)
            firsts = told.table.column("first_id").to_pylist() if told.table is not None else []
        found = told.find(*(batch.column(batch.schema.get_field_index(c)).to_numpy() for c in _DIGEST))
        for r, f in zip(batch.to_pylist(), found.tolist(), strict=True):
            first = firsts[f] if f >= 0 and len(r["payload"]) >= least else None
            revisit = first is not None and r["page_id"] != first
            yield {
                "page_id": r["page_id"], "url": r["url"], "payload": r["payload"], "digest": base64.b32encode(bytes.fromhex(r["digest"])).decode(),
                "record_type": "revisit" if revisit else "response", "refers_to": first if revisit else None}


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.UUID(bytes=hashlib.md5(f'{page_id}:{digest}'.encode()).digest()).urn}>"


def record_bytes(page_id, url, payload: bytes, digest: str, record_type: str, refers_to, date: str) -> bytes:
    """One uncompressed WARC/1.1 record."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if record_type == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one uncompressed record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(resolved: Resolved, folder: str, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes one gzip member per record into archives in folder; returns the index, settled."""

    filed, least = resolved.filed, resolved.min_revisit_bytes

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _filesystem(folder)
        where.create_dir(path, recursive=True)
        out, name, at, index = None, "", 0, []
        try:
            for r in records(batches, filed, least):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = where.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(member := _gzip(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid4().urn}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()))
                    at += len(member)
                member = _gzip(record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], r["record_type"], r["refers_to"], date))
                out.write(member)
                index.append({"page_id": r["page_id"], "url": r["url"], "record_type": r["record_type"], "refers_to": r["refers_to"], "payload_bytes": len(r["payload"]), "payload_digest": r["digest"], "archive": f"{folder}/{name}", "offset": at, "length": len(member)})
                at += len(member)
                if len(index) >= 256:
                    yield pa.RecordBatch.from_pylist(index, _INDEX_ARROW)
                    index = []
            if index:
                yield pa.RecordBatch.from_pylist(index, _INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    return settle(resolved.pages.rows.select("part", "page_id", "url", "payload", "digest", *_DIGEST).mapInArrow(put, INDEX))


_INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_RECORDS_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.string())])


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) ranges -> (offset, length, number of ranges) of single reads."""
    out: list[tuple[int, int, int]] = []
    for offset, length in ranges:
        if out and offset - (out[-1][0] + out[-1][1]) <= gap and offset + length - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(out[-1][1], offset + length - out[-1][0]), out[-1][2] + 1)
        else:
            out.append((offset, length, 1))
    return out


def read(index: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """The records that the index rows name, read back from the archives; digests are checked against the payloads.

    Index rows are dealt by archive and block of it, so that a task reads neighbouring ranges, and no archive is too large for one task.
    """

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, opened = None, None
        for batch in batches:
            rows = batch.select(["archive", "offset", "length", "payload_digest", "record_type"]).to_pylist()
            rows.sort(key=lambda r: (r["archive"], r["offset"]))
            at = 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end]["archive"] == rows[at]["archive"]:
                    end += 1
                if opened != rows[at]["archive"]:
                    if stream is not None:
                        stream.close()
                    where, path = _filesystem(rows[at]["archive"])
                    stream, opened = where.open_input_file(path), rows[at]["archive"]
                for offset, length, n in coalesce([(r["offset"], r["length"]) for r in rows[at:end]]):
                    data, out = stream.read_at(length, offset), []
                    for r in rows[at : at + n]:
                        fields, payload = parse_record(zlib.decompress(data[r["offset"] - offset : r["offset"] - offset + r["length"]], 31))
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        kind = fields["WARC-Type"]
                        if digest != r["payload_digest"] or kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{opened} at {r['offset']}: the digest differs from the payload's or the index's")
                        out.append({
                            "page_id": int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, "payload_bytes": len(payload) if kind == "response" else int(fields["X-Payload-Length"]),
                            "payload_digest": digest, "record_type": kind, "refers_to": int(fields["X-Refers-To-Page-ID"]) if kind == "revisit" else None,
                            "url": fields["WARC-Target-URI"], "payload": payload.decode("utf-8", "replace") if with_payload and kind == "response" else None,
                        })
                    yield pa.RecordBatch.from_pylist(out, _RECORDS_ARROW)
                    at += n
        if stream is not None:
            stream.close()

    block = F.floor(F.col("offset") / (64 << 20))
    near = index.repartition(n_tasks(index), "archive", block).sortWithinPartitions("archive", "offset")
    return near.mapInArrow(get, RECORDS)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = inplace.new_folder(pages, "warc")
    try:
        return settle(read(write(resolve(pages), folder), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:  # the query keeps digests only
        inplace.delete(folder)


SQL_OP2 = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, n, h, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('{ALPHABET}', CAST(1 + ((('0x' || substr(h, CAST(1 + (i // 4) * 5 AS INTEGER), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d"""
