"""WARC records as a chunked table.

An archive is a table of (record, chunk, data, digest): chunk 0 holds the record's WARC header and
HTTP head, the others parts of the payload of at most CHUNK bytes, and ``digest`` is the SHA-1 of the
payload up to and with that chunk. The data of a record's chunks, in order, are a WARC/1.1 record as
it stands in a file (``export_file`` writes such files). Writer and reader go through a payload
chunk by chunk, as slices of the bytes that the columnar batch holds anyway (batches are bounded in
bytes, see ``ship``), and keep one chunk and one running digest; no record is made into a string or copied whole.

Of the pages with equal payloads of at least ``least`` bytes the one with the largest page_id is a
response and the others are revisits of it; smaller payloads are responses.

Defined cases: null html is an empty payload; rows that repeat the largest page_id with the same
payload are all responses; rows with a null page_id are responses unless an equal payload has an id;
other columns are ignored; an empty table gives an empty archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, split_join, written

CHUNK = 1 << 18  # bytes of a chunk, at most
FEW = 200_000  # revisits up to which their table (16 bytes a row) is broadcast
DATE = "2024-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARCHIVE = "record string, chunk int, data binary, digest string"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_chunks(payload: memoryview, size: int = CHUNK) -> Iterator[bytes]:
    """The payload in parts of at most ``size`` bytes."""
    for at in range(0, len(payload), size):
        yield bytes(payload[at : at + size])


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'page {page_id}')}>"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _clean(value: str | None) -> str:
    """No line breaks in header values."""
    return re.sub(r"[\r\n]+", " ", value or "").strip()


def record_chunks(page_id: int | None, url: str | None, payload: memoryview, refers_to: int | None) -> Iterator[tuple[int, bytes, str]]:
    """(chunk, data, running digest) of one record."""
    running, length = hashlib.sha1(payload), len(payload)
    revisit = refers_to is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Payload-Digest", f"sha1:{_base32(running.digest())}"),
        ("X-Payload-Length", str(length)),
        *([("X-Page-ID", str(page_id))] if page_id is not None else []),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(HEAD) + (0 if revisit else length))),
    ]
    head = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + HEAD
    running, k = hashlib.sha1(), 0
    yield 0, head + (END if revisit or not length else b""), _base32(running.digest())
    if not revisit:
        left = length
        for k, part in enumerate(payload_chunks(payload), 1):
            running.update(part)
            left -= len(part)
            yield k, part + (b"" if left else END), _base32(running.digest())


def parse_head(data: bytes) -> tuple[dict[str, str], int]:
    """The WARC fields (names in lower case) of a record's first chunk and where its HTTP body begins."""
    stop = data.index(END)
    lines = data[:stop].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, data.index(END, stop + len(END)) + len(END)


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, row = TaskContext.get().partitionId(), 0
    types = [pa.string(), pa.int32(), pa.binary(), pa.string()]
    for batch in batches:
        out, size = [], 0
        for page_id, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            payload = memoryview(html.as_buffer() if html.is_valid else b"")
            for k, data, digest in record_chunks(page_id, url, payload, refers_to):
                out.append((f"{part}-{row}", k, data, digest))
                size += len(data)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["record", "chunk", "data", "digest"])
                    out, size = [], 0
            row += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["record", "chunk", "data", "digest"])


def write_archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as a chunked table in the shared folder and returns it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    body = F.coalesce("html", F.lit(""))
    keys = rows.select("page_id", F.sha1(F.encode(body, "UTF-8")).alias("sha"), F.octet_length(body).alias("size")).where(F.col("size") >= least)
    firsts = keys.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    revisits = written(split_join(keys, written(firsts, "firsts"), ["sha"], "n", rows.count()).where("page_id is null or page_id <> refers_to").select("page_id", "sha", "refers_to").distinct(), "revisits")
    rows = rows.withColumn("sha", F.sha1(F.encode(body, "UTF-8")))
    few = revisits.limit(FEW + 1).count() <= FEW
    side = (F.broadcast(revisits) if few else revisits).withColumnsRenamed({"page_id": "p", "sha": "s"})
    joined = rows.join(side, rows["page_id"].eqNullSafe(side["p"]) & (rows["sha"] == side["s"]), "left")
    return written(joined.select("page_id", "url", "html", "refers_to").mapInArrow(_write, ARCHIVE), "archive")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    at, fields, running, length, expected = None, {}, None, 0, 0

    def ended():
        whole, digest = int(fields["x-payload-length"]), fields["warc-payload-digest"].removeprefix("sha1:")
        kind = fields["warc-type"]
        if kind == "response" and (length != whole or _base32(running.digest()) != digest):
            raise ValueError(f"record {at}: {length} of {whole} payload bytes, or another digest")
        number = lambda k: int(fields[k]) if k in fields else None
        return number("x-page-id"), fields["warc-target-uri"], whole, digest, kind, number("x-refers-to-page-id")

    for batch in batches:
        out = []
        for i, (record, chunk, digest) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            data = batch.column(2)[i].as_buffer()
            if record != at:
                if at is not None:
                    out.append(ended())
                fields, body = parse_head(bytes(data))
                at, running, length, expected = record, hashlib.sha1(), 0, 0
                left = int(fields["content-length"]) - len(HEAD)
            else:
                body = 0
            if chunk != expected:
                raise ValueError(f"record {record}: chunk {expected} is missing")
            part = memoryview(data)[body : body + left]
            running.update(part)
            length += len(part)
            left -= len(part)
            expected += 1
            if _base32(running.copy().digest()) != digest:
                raise ValueError(f"record {record}: chunk {chunk} has another digest")
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(ended(), types, strict=True)], names=names)


def read_archive(archive: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of each record, every digest checked."""
    n = partitions(archive.sparkSession)
    rows = archive.select("record", "chunk", "data", "digest").repartition(n, "record").sortWithinPartitions("record", "chunk")
    return rows.mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_payloads(archive: DataFrame) -> DataFrame:
    """record, chunk, part: the payload bytes of responses, chunk by chunk."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for chunk, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = data[parse_head(data)[1] :] if chunk == 0 else data
                parts.append(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(parts, pa.binary())], names=["record", "chunk", "part"])

    return archive.select("record", "chunk", "data", "digest").mapInArrow(cut, "record string, chunk int, part binary")


def export_file(rows: Iterator, path: str) -> int:
    """Writes (record, chunk, data) rows, sorted, as one WARC file on a local path; returns its bytes."""
    size = 0
    with open(path, "wb") as f:
        for row in rows:
            size += f.write(row.data)
    return size
