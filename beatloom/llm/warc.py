"""Seekable Zstandard bundles of WARC records.

A bundle is a sequence of independent Zstandard frames, each holding whole WARC records, closed by a seek
table in the published seekable format: a skippable frame whose entries are the compressed and the
decompressed size of every frame. Any Zstandard reader can read a bundle from start to end; a reader that
knows the seek table jumps to one frame. The index table maps a record to its bundle, its frame and its
offset within the decompressed frame.

Equal payloads are stored once: the digests are aggregated first (digest, count and smallest id move, never
the payloads), and only digests that occur twice are kept for the join that marks revisits.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from beatloom.llm.staging import filesystem, spread, stage
from beatloom.session import work_dir

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX_SCHEMA = "record_id string, page_id long, bundle string, frame int, frame_offset long, record_bytes long"
RECORD_SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 100) -> DataFrame:
    """Rows (page_id, url, payload, payload_digest, payload_bytes, record_type, refers_to).

    Of rows with equal payloads of at least ``min_bytes``, those with the smallest page_id are responses and
    the others revisits of it. Null payloads are empty. Null page_ids never become the target of a revisit
    while another id is there; if all ids of a payload are null, all its rows are responses. Rows repeating
    the smallest page_id are responses each. An empty table gives no rows.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    first = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    first = stage(first.filter("copies > 1 and first_id is not null").drop("copies"), "warc-first")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def _record_id(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _record(row: dict, date: str) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP header only."""
    header = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = header + (b"" if row["record_type"] == "revisit" else row["payload"])
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_record_id(row['page_id'])}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + row["url"].replace("\r", "%0D").replace("\n", "%0A"))
    lines.append(f"WARC-Payload-Digest: sha256:{row['payload_digest']}")
    lines.append(f"X-Payload-Bytes: {row['payload_bytes']}")
    if row["refers_to"] is not None:
        lines.append(f"WARC-Refers-To: <{_record_id(row['refers_to'])}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(buffer: bytes, at: int) -> tuple[dict, int]:
    """The record at an offset of a decompressed frame, and the offset after it."""
    split = buffer.index(b"\r\n\r\n", at)
    names = dict(line.split(": ", 1) for line in buffer[at:split].decode().split("\r\n")[1:])
    start, size = split + 4, int(names["Content-Length"])
    block = buffer[start : start + size]
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    digest = names["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda key: int(names[key][1:-1].removeprefix("urn:page:") or -1) if key in names else None
    own = names["WARC-Record-ID"][1:-1]
    if names["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"payload of {own} does not match its digest")
    row = {
        "record_id": own, "page_id": None if own == _record_id(None) else number("WARC-Record-ID"), "url": names.get("WARC-Target-URI"),
        "record_type": names["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload_bytes": int(names["X-Payload-Bytes"]),
        "payload_digest": digest, "payload": payload if names["WARC-Type"] == "response" else None,
    }
    return row, start + size + 4


class BundleWriter:
    """Writes one bundle file; frames close at ``frame_bytes`` of raw records."""

    def __init__(self, folder: str, frame_bytes: int, level: int) -> None:
        system, base = filesystem(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.file = system.open_output_stream(f"{base}/{self.name}", compression=None)
        self.pack, self.frame_bytes = zstandard.ZstdCompressor(level=level), frame_bytes
        self.parts: list[bytes] = []
        self.raw = self.written = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, record: bytes) -> tuple[int, int]:
        """Append a record; its frame number and offset in the frame."""
        if self.raw and self.raw + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.raw
        self.parts.append(record)
        self.raw += len(record)
        return place

    def flush(self) -> None:
        if self.parts:
            frame = self.pack.compress(b"".join(self.parts))
            self.file.write(frame)
            self.frames.append((len(frame), self.raw))
            self.written += len(frame)
            self.parts, self.raw = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.file.close()


class BundleReader:
    """Random access to the frames of a bundle through its seek table."""

    def __init__(self, uri: str) -> None:
        system, path = filesystem(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, raw in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, raw))
            at += packed
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, raw = self.frames[number]
        return self.unpack.decompress(self.file.read_at(packed, at), max_output_size=raw)


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 1 << 28, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write marked rows (see ``mark_revisits``) to bundles below ``folder``; returns the index table.

    Each task writes its own bundles under fresh names, a new one after ``bundle_bytes``. The index is
    written with the files and names only bundles of tasks that were committed; what a lost task left
    behind is never read. A frame holds at least one record, so a record longer than ``frame_bytes`` has a
    frame of its own.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, system = None, filesystem(folder)
        system[0].create_dir(system[1], recursive=True)
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                record = _record(row, date)
                out = out or BundleWriter(folder, frame_bytes, level)
                frame, at = out.add(record)
                rows.append((_record_id(row["page_id"]), row["page_id"], f"{folder}/{out.name}", frame, at, len(record)))
                if out.written >= bundle_bytes:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()], strict=True)],
                names=["record_id", "page_id", "bundle", "frame", "frame_offset", "record_bytes"],
            )
        if out:
            out.close()

    return stage(records.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"record_id": pa.string(), "page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))


def read_bundles(index: DataFrame) -> DataFrame:
    """Every record of the bundles that an index names, frame by frame."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column(0).to_pylist():
                reader = BundleReader(bundle)
                for number in range(len(reader.frames)):
                    raw, at, rows = reader.frame(number), 0, []
                    while at < len(raw):
                        row, at = parse_record(raw, at)
                        rows.append(row)
                    yield _batch(rows)

    return spread(index.select("bundle").distinct(), "bundle").mapInArrow(read, RECORD_SCHEMA)


def read_records(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the page_ids in ``wanted``: only their frames are read, each once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, frame, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = BundleReader(bundle).frame(frame)
                yield _batch([parse_record(raw, at)[0] for at in sorted(offsets)])

    places = index.join(wanted.select("page_id").distinct(), "page_id", "left_semi")
    return places.groupBy("bundle", "frame").agg(F.collect_list("frame_offset").alias("offsets")).mapInArrow(read, RECORD_SCHEMA)


def payload_columns() -> list[Column]:
    """Length and digest of a record's full payload: of a response from the stored bytes themselves."""
    response = F.col("record_type") == "response"
    return [
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
    ]


def op2_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back and return one row per page."""
    records = mark_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    index = write_bundles(records, work_dir(spark, "warc"))
    return read_bundles(index).select("page_id", *payload_columns(), "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
     d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
     f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first_id from d)
select page_id, payload_bytes, payload_digest,
       case when first_id is not null and page_id is distinct from first_id then 'revisit' else 'response' end as record_type,
       case when first_id is not null and page_id is distinct from first_id then first_id end as refers_to
from f
"""
