"""WARC records in seekable Zstandard bundles.

Each task packs its records into bundles. A bundle is a ``.warc.zst`` byte string: independent
frames of about ``frame_bytes``, then a skippable frame with the seek table (compressed and
decompressed size of each frame, then the footer). The index maps every record identifier to its
bundle, frame and offset inside the decompressed frame, so one record costs one frame.

Of records with equal payloads the one with the largest identifier is a response and the others
are revisits of it. Which payloads are shared is found on digests alone, before any payload moves.

Defined cases: a null payload is an empty one; empty payloads are equal payloads as long as
``min_shared_bytes`` is 0; records longer than a frame get a frame of their own; a null url is an
empty target; rows with a null identifier can't be referred to and raise an error; of repeated
identifiers each row is a record. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from expband.llm import shared

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 24
LEVEL = 3
# Magic numbers of the skippable frame and of the seek table's footer.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WARC_DATE = "2024-01-01T00:00:00Z"

BUNDLE_SCHEMA = ("bundle_id string, archive binary, "
                 "entries array<struct<record_id: bigint, frame: int, offset: bigint, bytes: bigint>>")
RECORD_SCHEMA = ("record_id bigint, record_type string, target string, payload_digest string, "
                 "stored_bytes bigint, refers_to bigint, payload binary")


def roles(pages: DataFrame, min_shared_bytes: int = 0) -> DataFrame:
    """record_id, target, payload, digest, refers_to; the last only for revisits.

    Digests are counted with map-side combine; only shared ones are joined back, without payloads.
    """
    record = pages.select(
        F.when(F.col("page_id").isNull(), F.raise_error(F.lit("a record has no identifier")).cast("bigint"))
        .otherwise(F.col("page_id").cast("bigint")).alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    record = record.withColumn("digest", F.unhex(F.sha1("payload")))
    keys = record.filter(F.length("payload") >= min_shared_bytes).select("digest", "record_id")
    shared_keys = (keys.groupBy("digest").agg(F.max("record_id").alias("response_id"),
                                              F.count("*").alias("copies"))
                   .filter("copies > 1").drop("copies"))
    # Small rows: one per record that has a copy.
    revisits = (keys.join(shared_keys, "digest").filter("record_id <> response_id")
                .groupBy("record_id", "digest").agg(F.max("response_id").alias("refers_to")))
    return record.join(revisits, ["record_id", "digest"], "left")


def _record(record_id: int, target: str, payload: bytes, digest: bytes, refers_to: int | None) -> bytes:
    """A WARC/1.1 record around an HTTP response; a revisit keeps the HTTP head only."""
    name = base64.b32encode(digest).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {WARC_DATE}",
             "WARC-Target-URI: " + target.replace("\r", "%0D").replace("\n", "%0A"),
             f"WARC-Payload-Digest: sha1:{name}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                  "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


class Bundle:
    """Collects records into frames; ``close`` appends the seek table."""

    def __init__(self, frame_bytes: int, level: int):
        import zstandard

        self.press = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.frame_bytes, self.parts, self.sizes = frame_bytes, [], []
        self.open, self.open_bytes, self.stored, self.entries = [], 0, 0, []

    def add(self, record_id: int, record: bytes) -> None:
        if self.open and self.open_bytes + len(record) > self.frame_bytes:
            self._frame()
        self.entries.append((record_id, len(self.parts), self.open_bytes, len(record)))
        self.open.append(record)
        self.open_bytes += len(record)

    def _frame(self) -> None:
        packed = self.press.compress(b"".join(self.open))
        self.sizes.append((len(packed), self.open_bytes))
        self.parts.append(packed)
        self.stored += len(packed)
        self.open, self.open_bytes = [], 0

    def close(self) -> bytes:
        if self.open:
            self._frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        return b"".join([*self.parts, struct.pack("<II", SKIPPABLE, len(table) + len(footer)), table, footer])


def seek_table(archive: bytes) -> list[tuple[int, int, int]]:
    """Start, compressed size and decompressed size of each frame, from the footer."""
    frames, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("the bundle has no plain seek table")
    at, out = len(archive) - 9 - 8 * frames, []
    if struct.unpack("<II", archive[at - 8:at]) != (SKIPPABLE, 8 * frames + 9):
        raise ValueError("the seek table's frame is damaged")
    start = 0
    for k in range(frames):
        size, plain = struct.unpack("<II", archive[at + 8 * k:at + 8 * k + 8])
        out.append((start, size, plain))
        start += size
    return out


def parse(record: bytes) -> tuple[str, str, str, int | None, bytes]:
    """Type, target, digest, the record referred to, and the payload of a WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    refers = fields.get("WARC-Refers-To")
    return (fields["WARC-Type"], fields["WARC-Target-URI"],
            fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            int(refers[len("<urn:page:"):-1]) if refers else None,
            body.partition(b"\r\n\r\n")[2])


def pack(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
         level: int = LEVEL) -> DataFrame:
    """Bundles of the records of each partition, with the index entries beside the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        schema = pa.schema([("bundle_id", pa.string()), ("archive", pa.binary()),
                            ("entries", pa.list_(pa.struct([("record_id", pa.int64()), ("frame", pa.int32()),
                                                            ("offset", pa.int64()), ("bytes", pa.int64())])))])

        def closed(bundle: Bundle) -> pa.RecordBatch:
            entries = [dict(zip(("record_id", "frame", "offset", "bytes"), e)) for e in bundle.entries]
            return pa.RecordBatch.from_pylist([{"bundle_id": f"{task:06d}-{made:06d}",
                                                "archive": bundle.close(), "entries": entries}], schema)

        bundle = Bundle(frame_bytes, level)
        for batch in batches:
            columns = [batch.column(c) for c in ("record_id", "target", "payload", "digest", "refers_to")]
            for row in zip(*columns):
                record_id, *rest = (x.as_py() for x in row)
                bundle.add(record_id, _record(record_id, *rest))
                if bundle.stored + bundle.open_bytes >= bundle_bytes:
                    yield closed(bundle)
                    bundle, made = Bundle(frame_bytes, level), made + 1
        if bundle.entries:
            yield closed(bundle)

    return records.mapInArrow(run, BUNDLE_SCHEMA)


def write(pages: DataFrame, path: str, **options: int) -> None:
    """Write bundles to a table of ``bundle_id, archive, entries`` (bytes are stored as they are)."""
    pack(roles(pages), **options).write.option("compression", "none").parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """record_id, bundle_id, frame, offset, bytes: where each record lies."""
    return (spark.read.parquet(path).select("bundle_id", F.explode("entries").alias("e"))
            .select("e.record_id", "bundle_id", "e.frame", "e.offset", "e.bytes"))


def fetch(bundles: DataFrame, wanted: DataFrame | None = None, with_payload: bool = True) -> DataFrame:
    """Read records by the index: each needed frame is decompressed once.

    ``wanted`` (record_id) restricts what is read; None reads all. The payload's digest is computed
    anew and must match the record's for a response.
    """
    if wanted is not None:
        entry = bundles.select("bundle_id", F.explode("entries").alias("e"))
        keep = wanted.select(F.col("record_id").alias("wanted_id")).distinct()
        chosen = (entry.join(keep, F.col("e.record_id") == F.col("wanted_id"), "left_semi")
                  .groupBy("bundle_id").agg(F.collect_list("e").alias("entries")))
        bundles = bundles.drop("entries").join(chosen, "bundle_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        schema = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("target", pa.string()),
                            ("payload_digest", pa.string()), ("stored_bytes", pa.int64()),
                            ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for archive, entries in zip(batch.column("archive"), batch.column("entries")):
                archive = archive.as_py()
                table = seek_table(archive)
                by_frame: dict[int, list[dict]] = {}
                for e in entries.as_py():
                    by_frame.setdefault(e["frame"], []).append(e)
                for frame, found in sorted(by_frame.items()):
                    start, size, plain = table[frame]
                    data = expand.decompress(archive[start:start + size], max_output_size=plain)
                    rows = []
                    for e in found:
                        kind, target, digest, refers, payload = parse(data[e["offset"]:e["offset"] + e["bytes"]])
                        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"record {e['record_id']} doesn't match its digest")
                        rows.append((e["record_id"], kind, target, digest, len(payload), refers,
                                     payload if with_payload and kind == "response" else None))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return bundles.select("archive", "entries").mapInArrow(run, RECORD_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Adds ``payload_bytes``: a revisit's are those of the response it refers to."""
    sizes = (records.filter("record_type = 'response'")
             .groupBy(F.col("record_id").alias("response_id")).agg(F.max("stored_bytes").alias("response_bytes")))
    return (records.join(sizes, F.col("refers_to") == F.col("response_id"), "left")
            .withColumn("payload_bytes", F.coalesce("response_bytes", "stored_bytes"))
            .drop("response_id", "response_bytes"))


def of_pages(spark: SparkSession, path: str) -> DataFrame:
    """Write every page, read all archives back, and describe each record."""
    folder = shared.folder(spark, "warc")
    write(spark.read.parquet(path).select("page_id", "url", "html"), folder)
    records = resolved(fetch(spark.read.parquet(folder), with_payload=False))
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest",
                          "record_type", "refers_to")
