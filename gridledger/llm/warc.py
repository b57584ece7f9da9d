"""WARC records in seekable Zstandard bundles.

Every record is in one independent frame, a frame holds records of at least
``FRAME_BYTES`` together, and a bundle ends with a seek table in a skippable frame:
compressed and uncompressed size of each frame, then the footer. An index maps
record ids to bundle, frame, offset inside the frame and length, so one record
is read with one ranged read and one frame's decompression.

Of equal payloads of at least ``LEAST_REVISIT`` bytes the row with the smallest
page id is written as a response, the others as revisits that name it.

Bundles are written by Spark's own Parquet writer, one row per bundle with its
bytes: the committed output holds each bundle once whatever tasks are lost or
run twice, and any store that Spark writes to will do. ``export_bundles`` puts
them into plain ``.warc.zst`` files.

Rows: a null html is an empty payload, a null url an empty target. Rows with a
null page id are written as responses and never referred to. Repeated page ids
are separate records; of equal (id, payload) rows with a long payload one is the
response and the rest revisit their own id. Other columns are ignored.
"""
from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAST_REVISIT = 100
#: Uncompressed bytes after which a frame is closed, and compressed bytes after which a bundle is.
FRAME_BYTES = 256 * 1024
BUNDLE_BYTES = 8 * 1024 * 1024
LEVEL = 3
#: Fixed values of the seekable format: skippable frame with the table, footer magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1

INDEX = "array<struct<record: string, frame: int, offset: long, length: long>>"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """Skippable frame with (compressed, uncompressed) sizes and the footer."""
    body = b"".join(struct.pack("<II", *sizes) for sizes in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed, uncompressed) of every frame, read from the end of a bundle."""
    count, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    table, at, out = len(bundle) - 9 - count * width, 0, []
    for n in range(count):
        compressed, whole = struct.unpack("<II", bundle[table + n * width:table + n * width + 8])
        out.append((at, compressed, whole))
        at += compressed
    return out


def record_of(page_id: int | None, number: int, url: str | None, payload: bytes, digest: str,
              first: int | None, revisit: bool) -> tuple[str, bytes]:
    """Record id and bytes. The id is made from the page id and the number of the record in its bundle."""
    name = f"urn:page:{'none' if page_id is None else page_id}"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}",
             f"X-Payload-Length: {len(payload)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <urn:page:{first}>"]
        payload = b""
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return name, "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    length = int(headers["content-length"])
    if rest[length:] != b"\r\n\r\n":
        raise ValueError("record of another length")
    return headers, rest[:length]


class _Bundle:
    def __init__(self, level: int) -> None:
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.parts: list[bytes] = []
        self.frames: list[tuple[int, int]] = []
        self.index: list[dict] = []
        self.frame = bytearray()
        self.size = 0

    def add(self, name: str, record: bytes, frame_bytes: int) -> None:
        self.index.append({"record": name, "frame": len(self.frames), "offset": len(self.frame), "length": len(record)})
        self.frame += record
        if len(self.frame) >= frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.frame:
            packed = self.compress(bytes(self.frame))
            self.parts.append(packed)
            self.frames.append((len(packed), len(self.frame)))
            self.size += len(packed)
            self.frame = bytearray()

    def done(self) -> pa.RecordBatch:
        self.close_frame()
        body = b"".join([*self.parts, seek_table(self.frames)])
        kind = pa.list_(pa.struct([("record", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        return pa.record_batch([pa.array([hashlib.sha256(body).hexdigest()]), pa.array([body], pa.binary()),
                                pa.array([self.index], kind)], names=["bundle", "body", "records"])


def _bundles(frame_bytes: int, bundle_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = _Bundle(level)
        for batch in batches:
            for page_id, url, payload, digest, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, data = record_of(page_id, len(bundle.index), url, payload, digest, first, revisit)
                bundle.add(name, data, frame_bytes)
                if bundle.size >= bundle_bytes:
                    yield bundle.done()
                    bundle = _Bundle(level)
        if bundle.index:
            yield bundle.done()
    return run


def bundles(pages: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES,
            level: int = LEVEL, least: int = LEAST_REVISIT) -> DataFrame:
    """(bundle, body, records): bundles of the records of ``pages``, named by their digest.

    Only digests are grouped; a page's html moves once, to meet the verdict on its row.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    known = (rows.where((F.length("payload") >= least) & F.col("page_id").isNotNull())
             .groupBy("page_id", "digest").agg(F.count("*").alias("rows")))
    firsts = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("rows").alias("all_rows")).where("all_rows > 1")
    verdicts = known.join(firsts, "digest").select("page_id", "digest", "first")
    joined = rows.join(verdicts, ["page_id", "digest"], "left")
    again = F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("digest")) > 1
    revisit = F.col("first").isNotNull() & ((F.col("first") != F.col("page_id")) | F.col("again"))
    slim = (joined.withColumn("again", again)
            .select("page_id", "url", "payload", "digest", "first", F.coalesce(revisit, F.lit(False)).alias("revisit")))
    return slim.mapInArrow(_bundles(frame_bytes, bundle_bytes, level), f"bundle string, body binary, records {INDEX}")


def write(pages: DataFrame, path: str, **options) -> None:
    """Write bundles, their record lists beside them, as a Parquet folder."""
    bundles(pages, **options).write.mode("overwrite").parquet(path)


def index(spark: SparkSession, path: str) -> DataFrame:
    """(record, bundle, frame, offset, length) of every record, without reading the bundles' bytes."""
    return (spark.read.parquet(path).select("bundle", F.explode("records").alias("r"))
            .select("r.record", "bundle", "r.frame", "r.offset", "r.length"))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for body, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            columns: list[list] = [[] for _ in range(6)]
            frames, at, frame = frames_of(body), None, b""
            for r in records:
                if r["frame"] != at:
                    at = r["frame"]
                    start, size, whole = frames[at]
                    frame = expand(body[start:start + size], max_output_size=whole)
                headers, payload = parse_record(frame[r["offset"]:r["offset"] + r["length"]])
                kind = headers["warc-type"]
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{r['record']}: payload of another digest")
                number = lambda x: None if x in (None, "none") else int(x)
                first = headers.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                row = (number(r["record"].removeprefix("urn:page:")), int(headers["x-payload-length"]), digest, kind,
                       number(first or None), payload if kind == "response" else None)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                  names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read(spark: SparkSession, path: str, records: DataFrame | None = None) -> DataFrame:
    """Records read back over index and seek tables, payloads of responses checked against their digest.

    ``records`` (record) asks for some of them: only their bundles and frames are opened.
    """
    stored = spark.read.parquet(path)
    if records is not None:
        wanted = index(spark, path).join(records.select("record").distinct(), "record", "left_semi")
        lists = wanted.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("frame", "offset", "record", "length"))).alias("asked"))
        picked = F.transform("asked", lambda r: F.struct(r.record.alias("record"), r.frame.alias("frame"),
                                                         r.offset.alias("offset"), r.length.alias("length")))
        stored = stored.select("bundle", "body").join(lists.withColumn("records", picked), "bundle")
    return stored.select("body", "records").mapInArrow(
        _records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def export_bundles(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Write each bundle as ``<folder>/<bundle>.warc.zst`` (a shared folder or an Arrow file system address).

    A file appears under its name only when it is whole, so tasks may run again. Returns (bundle, file); an action
    on it does the writing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs
        for batch in batches:
            files = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, at = fs.FileSystem.from_uri(folder)
                system.create_dir(at, recursive=True)
                part = f"{at}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as out:
                    out.write(body)
                system.move(part, f"{at}/{name}.warc.zst")
                files.append(f"{folder}/{name}.warc.zst")
            yield pa.record_batch([batch.column(0), pa.array(files, pa.string())], names=["bundle", "file"])
    return spark.read.parquet(path).select("bundle", "body").mapInArrow(run, "bundle string, file string")
