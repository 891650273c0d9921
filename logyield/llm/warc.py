"""WARC archives of pages, written and read back as chunk rows.

**Writing.** A payload is cut into chunks of at most ``chunk_bytes``; a row is one chunk with its record's identifier and
the chunk's number, and carries the SHA-1 of the payload up to and including it (the last one's is the payload digest).
Only a view of the payload moves; no second copy of a whole payload is made. A chunk is one WARC record: the first of a
payload is the ``response``, the others are ``continuation`` segments that name it, as WARC 1.0 lays down. Of equal
payloads of at least ``least_bytes`` one record (the largest page id) is the response, the others are ``revisit`` records
without payload that refer to it.

Which records are equal is found from (digest, size) alone. Only records whose digest may occur twice (a bit table of
fixed size tells) are shuffled with their payload, a hot digest over many salts; all others are written where they
were read. Archives are gzip files written and read by Spark's text source on any file system it knows: the line
separator is the end of a record, and for reading the start of the next one too. So that these bytes never occur inside a
block, chunks are also cut in the middle of any ``CRLF CRLF WARC/1.0`` of a payload and of a leading ``WARC/1.0``.

**Reading.** Each record is parsed on its own, its length and block digest checked. Chunks of longer payloads are brought
together by record identifier in chunk order and only streamed through the payload's digest; a payload that does not
match its digest, lacks a chunk or has another length fails the job. File errors fail the task and are retried.

A null html is an empty payload of 0 bytes. Repeated rows are records of their own; equal payloads under the same, largest
page id are all responses. A null page id is smaller than any other; it is read back as null. Null urls are left out,
control characters in urls are percent-encoded. Extra columns are not read. An empty table makes an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logyield.session import new_table_path

from .common import aggregate_salted, kept_table, salt_of, suspects, texts_of

CHUNK_BYTES = 64 << 10
VERSION = b"WARC/1.0"
END = b"\r\n\r\n"
BETWEEN = END + VERSION + b"\r\n"
DATE = "1970-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"

CHUNKS = (
    "record_id string, page_id string, url string, chunk int, chunks int, payload_bytes long, payload_digest string,"
    " running_digest binary, data binary"
)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def cuts(payload: bytes, chunk_bytes: int) -> list[int]:
    """Ends of the chunks: at most ``chunk_bytes`` each, none holding or starting what looks like a record's start."""
    spoof = END + VERSION
    stops, at = [], payload.find(spoof)
    while at >= 0:
        stops.append(at + len(END) + 2)
        at = payload.find(spoof, at + 1)
    if payload.startswith(VERSION):
        stops.insert(0, 4)
    stops.append(len(payload))
    ends, begin = [], 0
    for stop in stops:
        while stop - begin > chunk_bytes:
            begin += chunk_bytes
            if payload.startswith(VERSION, begin):
                begin -= 1
            ends.append(begin)
        if stop > begin or not ends:
            ends.append(stop)
            begin = stop
    return ends


def chunk_rows(pages: DataFrame, html: str = "html", key: str = "page_id", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            ids, urls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for page_id, url, payload in zip(ids, urls, texts_of(batch, "_html")):
                view = memoryview(payload)
                whole = hashlib.sha1(payload)
                digest = base32(whole.digest())
                record = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{part}/{number}/{page_id}/{digest}"))
                number += 1
                ends = cuts(payload, chunk_bytes)
                running, begin = hashlib.sha1(), 0
                for k, end in enumerate(ends):
                    running.update(view[begin:end])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in
                         ((record, pa.string()), (page_id, pa.string()), (url, pa.string()), (k, pa.int32()), (len(ends), pa.int32()),
                          (len(payload), pa.int64()), (digest, pa.string()), (running.copy().digest(), pa.binary()),
                          (view[begin:end].tobytes(), pa.binary()))],
                        ["record_id", "page_id", "url", "chunk", "chunks", "payload_bytes", "payload_digest", "running_digest", "data"],
                    )
                    begin = end

    chosen = pages.select(F.col(key).cast("string").alias("page_id"), F.col("url"), F.col(html).alias("_html"))
    return chosen.mapInArrow(merged(run), CHUNKS)


def merged(run, most_bytes: int = 4 << 20):
    """``run`` with its many small batches put together up to a few megabytes."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in run(batches):
            waiting.append(batch)
            size += batch.nbytes
            if size >= most_bytes:
                yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()
                waiting, size = [], 0
        if waiting:
            yield from pa.Table.from_batches(waiting).combine_chunks().to_batches()

    return wrapped


def classified(chunks: DataFrame, kind: str, least_bytes: int) -> DataFrame:
    """``chunks`` with refers_page and refers_record (null for responses); ``kind``: the page id's own type."""
    hashed = F.xxhash64("payload_digest").alias("hash")
    heads = chunks.where("chunk = 0").where(F.col("payload_bytes") >= least_bytes).select(
        "payload_digest", "payload_bytes", "record_id", F.col("page_id").cast(kind).alias("id")
    )
    twice = heads.groupBy("payload_digest").agg(F.count("*").alias("n")).where("n > 1").select(hashed)
    alone, copies = suspects(chunks.select("*", hashed), twice, "hash")
    largest = F.struct(F.col("id").isNotNull().alias("real"), "id", "record_id")
    winners = aggregate_salted(
        heads, ["payload_digest", "payload_bytes"], ["record_id"],
        {"n": F.count("*"), "best": F.max(largest)}, {"n": F.sum("n"), "best": F.max("best")},
    ).where("n > 1")
    found = copies.withColumn("_salt", salt_of("record_id")).join(
        winners, ["payload_digest", "payload_bytes", "_salt"], "left"
    )
    other = F.col("best").isNotNull() & ~F.col("page_id").cast(kind).eqNullSafe(F.col("best.id"))
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    known = found.select(
        *names, F.when(other, F.col("best.id").cast("string")).alias("refers_page"),
        F.when(other, F.col("best.record_id")).alias("refers_record"),
    ).where("refers_record IS NULL OR chunk = 0")  # a revisit has no payload
    nothing = F.lit(None).cast("string")
    return alone.select(*names, nothing.alias("refers_page"), nothing.alias("refers_record")).unionByName(known)


def header(fields: list[tuple[str, object]]) -> bytes:
    return VERSION + b"\r\n" + "\r\n".join(f"{name}: {value}" for name, value in fields if value is not None).encode("utf-8") + END


def clean_uri(url: str | None) -> str | None:
    return None if url is None else "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in url)


def records(chunks: DataFrame) -> DataFrame:
    """One column ``value``: each classified chunk as a WARC record without the two line ends that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                revisit = row["refers_record"] is not None
                data = b"" if revisit else row["data"]
                number, many, last = row["chunk"] + 1, row["chunks"] > 1 and not revisit, row["chunk"] + 1 == row["chunks"]
                own = row["record_id"] if number == 1 else str(uuid.uuid5(uuid.UUID(row["record_id"]), str(number)))
                fields = [
                    ("WARC-Type", "revisit" if revisit else "response" if number == 1 else "continuation"),
                    ("WARC-Record-ID", f"<urn:uuid:{own}>"),
                    ("WARC-Date", DATE),
                    ("WARC-Target-URI", clean_uri(row["url"])),
                    ("Page-ID", row["page_id"]),
                    ("Payload-Length", row["payload_bytes"]),
                    ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
                    ("WARC-Block-Digest", f"sha1:{base32(hashlib.sha1(data).digest())}"),
                    ("Running-Digest", f"sha1:{base32(row['running_digest'])}" if many else None),
                    ("WARC-Segment-Number", number if many else None),
                    ("WARC-Segment-Origin-ID", f"<urn:uuid:{row['record_id']}>" if number > 1 else None),
                    ("WARC-Segment-Total-Length", row["payload_bytes"] if many and last else None),
                    ("WARC-Refers-To", f"<urn:uuid:{row['refers_record']}>" if revisit else None),
                    ("Refers-To-Page-ID", row["refers_page"]),
                    ("WARC-Profile", SAME_PAYLOAD if revisit else None),
                    ("Content-Type", "text/html; charset=utf-8"),
                    ("Content-Length", len(data)),
                ]
                out.append(header(fields) + data)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return chunks.mapInArrow(run, "value binary")


def write_archives(pages: DataFrame, path: str, html: str = "html", key: str = "page_id", least_bytes: int = 0,
                   chunk_bytes: int = CHUNK_BYTES) -> None:
    """Writes gzip-compressed WARC files below ``path``."""
    kind = pages.schema[key].dataType.simpleString()
    # The table is stored: identifiers name the task that cut the record, and all that reads it must see the same ones.
    chunks = classified(kept_table(chunk_rows(pages, html, key, chunk_bytes), "warc-chunks"), kind, least_bytes)
    lines = records(chunks).select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", END.decode()).option("compression", "gzip").text(path)


PARSED = (
    "record_id string, page_id string, url string, record_type string, chunk int, last boolean, payload_bytes long,"
    " payload_digest string, refers_to string, data binary"
)


def parse_record(raw: bytes) -> dict:
    """One record; raises ValueError where length or block digest are wrong."""
    raw = raw.removeprefix(VERSION + b"\r\n")
    top, _, rest = raw.partition(END)
    fields = dict(line.split(": ", 1) for line in top.decode("utf-8").split("\r\n"))
    size = int(fields["Content-Length"])
    data = rest[:size]
    if len(data) != size or rest[size:] not in (b"", END):
        raise ValueError(f"record {fields['WARC-Record-ID']}: {len(rest)} bytes, {size} announced")
    if fields["WARC-Block-Digest"] != f"sha1:{base32(hashlib.sha1(data).digest())}":
        raise ValueError(f"record {fields['WARC-Record-ID']}: block digest differs")
    number = int(fields.get("WARC-Segment-Number", 1))
    return {
        "record_id": fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"]).removeprefix("<urn:uuid:").removesuffix(">"),
        "page_id": fields.get("Page-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "chunk": number - 1,
        "last": "WARC-Segment-Number" not in fields or "WARC-Segment-Total-Length" in fields,
        "payload_bytes": int(fields["Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": fields.get("Refers-To-Page-ID"),
        "data": data,
    }


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of the archives; without ``with_data`` checked one-chunk payloads are left out."""
    lines = spark.read.option("lineSep", BETWEEN.decode()).text(path).select(F.col("value").cast("binary").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("record_id", pa.string()), ("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
             ("chunk", pa.int32()), ("last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
             ("refers_to", pa.string()), ("data", pa.binary())]
        )
        for batch in batches:
            rows = [parse_record(raw) for raw in batch.column(0).to_pylist()]
            for row in rows:
                if row["chunk"] == 0 and row["last"] and row["record_type"] == "response":
                    if row["payload_bytes"] != len(row["data"]) or row["payload_digest"] != base32(hashlib.sha1(row["data"]).digest()):
                        raise ValueError(f"record {row['record_id']}: payload differs")
                    if not with_data:
                        row["data"] = None
            yield pa.RecordBatch.from_pylist(rows, schema)

    return lines.mapInArrow(run, PARSED)


def read_archives(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record, all payloads checked."""
    ordered = (
        read_chunks(spark, path, with_data=False).repartition("record_id").sortWithinPartitions("record_id", "chunk")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        head, digest, size, following = None, None, 0, 0

        def unfinished() -> None:
            if head is not None:
                raise ValueError(f"record {head['record_id']}: chunks after {following - 1} are missing")

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["chunk"] == 0:
                    unfinished()
                    out.append([row[n] for n in names])
                    if row["last"]:
                        continue
                    head, digest, size, following = row, hashlib.sha1(), 0, 0
                if head is None or row["record_id"] != head["record_id"] or row["chunk"] != following:
                    raise ValueError(f"record {row['record_id']}: chunk {row['chunk']} has no place")
                digest.update(row["data"])
                size += len(row["data"])
                following += 1
                if row["last"]:
                    if size != head["payload_bytes"] or base32(digest.digest()) != head["payload_digest"]:
                        raise ValueError(f"record {head['record_id']}: payload differs")
                    head = None
            columns = list(zip(*out)) if out else [[]] * len(names)
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        unfinished()

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    found = ordered.mapInArrow(run, schema)
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def round_trip(pages: DataFrame, html: str = "html", key: str = "page_id", least_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes ``pages`` to archives below the shared folder and reads them back."""
    path = new_table_path(pages.sparkSession, "warc")
    write_archives(pages, path, html, key, least_bytes, chunk_bytes)
    return read_archives(pages.sparkSession, path, pages.schema[key].dataType.simpleString())
