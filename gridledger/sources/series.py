"""Hourly series: JSON-lines records and their observations."""
from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.functions.numbers import parse_numeric
from gridledger.functions.plan import compute_once
from gridledger.functions.text import blank, strip
from gridledger.functions.times import parse_period
from gridledger.session import shared_folder
from gridledger.sources.landed import (
    BATCH_BYTES, DAMAGED, UNREADABLE, ArchiveReader, chunks, opened, read_archives)

SERIES_FIELDS = ("series_id", "name", "units", "unitsshort", "f", "last_updated", "description")
LINE_SCHEMA = "file string, block long, row long, line string"
SERIES_SUFFIXES = (".txt", ".json", ".jsonl")
#: Lines of a batch, and of a landed file.
BATCH_ROWS, LANDED_ROWS = 5_000, 100_000


def read_series_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a file-order key that survives splitting a file."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"))


def _line_batches(archive: zipfile.ZipFile, member: zipfile.ZipInfo, file: str, block: int) -> Iterator[pa.RecordBatch]:
    """Lines of a member as they stream; one that is damaged ends with a line that is no record, numbered -1."""
    row, held, size, pieces = 0, [], 0, []

    def batch(first: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.record_batch([pa.array([file] * n), pa.array([block] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()),
                                pa.array(lines, pa.string())], names=["file", "block", "row", "line"])

    def text(line: bytes) -> str:
        try:
            return (line if row or held else line.removeprefix(b"\xef\xbb\xbf")).decode().rstrip("\r\n")
        except UnicodeDecodeError:
            return "<undecodable line>"

    try:
        for chunk in chunks(archive, member):
            start, *rest = chunk.split(b"\n")
            pieces.append(start)
            if not rest:
                continue  # the line goes on
            for line in (b"".join(pieces), *rest[:-1]):
                held.append(text(line))
                size += len(line)
            pieces = rest[-1:]
            if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield batch(row, held)
                row, held, size = row + len(held), [], 0
        if last := b"".join(pieces):
            held.append(text(last))
        if held:
            yield batch(row, held)
    except (*DAMAGED, *UNREADABLE):
        yield batch(-1, ["<unreadable member>"])


def _members(archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [m for m in archive.infolist() if m.filename.lower().endswith(SERIES_SUFFIXES)]


class SeriesArchiveReader(ArchiveReader):
    """An archive's members, in ranges of ``split`` bytes where it is large."""

    def parts(self, path: str, size: int) -> list[tuple[int, tuple]]:
        if size < self.split:
            return [(size, (path, 0, None))]
        try:
            with opened(path) as stream, zipfile.ZipFile(stream) as archive:
                sizes = [m.compress_size for m in _members(archive)]
        except (*DAMAGED, *UNREADABLE):
            sizes = []
        cuts, held = [0], 0
        for n, more in enumerate(sizes):
            if held and held + more > self.split:
                cuts.append(n)
                held = 0
            held += more
        return [(self.split, (path, a, b)) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]

    def batches(self, part: tuple) -> Iterator[pa.RecordBatch]:
        path, first, end = part
        try:
            with opened(path) as stream, zipfile.ZipFile(stream) as archive:
                members = _members(archive)
                for block, member in list(enumerate(members))[first:end]:
                    yield from _line_batches(archive, member, path, block)
                found = bool(members)
        except (*DAMAGED, *UNREADABLE):
            found = False
        if not found:
            yield pa.record_batch([pa.array([path]), pa.array([0], pa.int64()), pa.array([-1], pa.int64()), pa.array(["<unreadable archive>"])],
                                  names=["file", "block", "row", "line"])


def read_series_archives(spark: SparkSession, path: str, folder: str | None = None) -> DataFrame:
    """Lines of the landed archives of JSON lines under a path, whatever their size.

    One streaming pass over each member, which tests its checksum as well, lands the lines in ``folder`` (by default a new
    one in the session's shared folder) as Parquet files of ``LANDED_ROWS`` lines; parsing then spreads over all of them,
    though a ZIP member itself cannot be split. ``file, block, row`` is the order of archive, member and line.
    A damaged member or archive is one line that is no record; none of its other lines is kept.
    """
    folder = folder or shared_folder(spark)
    (read_archives(spark, SeriesArchiveReader({"path": path}), LINE_SCHEMA)
     .write.option("maxRecordsPerFile", LANDED_ROWS).parquet(folder))
    lines = spark.read.parquet(folder)
    faults = lines.where("row < 0")
    whole = lines.where("row >= 0").join(faults.select("file", "block"), ["file", "block"], "left_anti")
    return whole.select(*lines.columns).unionByName(faults)


def _field(name: str) -> Column:
    return F.try_variant_get("record", f"$.{name}", "string")


def parse_series_lines(lines: DataFrame, keep: tuple[str, ...] = ("file", "block", "row")) -> DataFrame:
    """One row per non-blank line, ``reject_reason`` null for usable series."""
    parsed = compute_once(lines.where(~blank(F.col("line"))), {"record": F.try_parse_json("line")})
    listed = F.expr("try_variant_get(record, '$.data', 'array<variant>')")
    reason = (
        F.when(F.col("record").isNull(), "malformed_json")
        .when(blank(F.col("series_id")), "no_series_id")
        .when(F.col("data").isNull(), "no_data_array")
    )
    typed = compute_once(parsed, {**{n: _field(n) for n in SERIES_FIELDS}, "data": listed})
    return typed.withColumn("reject_reason", reason).select(
        *keep, *SERIES_FIELDS, "data", "reject_reason")


def valid_series(series: DataFrame) -> DataFrame:
    """Unit present (long name first) and hourly or unstated frequency."""
    unit = F.coalesce(F.nullif(strip(F.col("units")), F.lit("")),
                      F.nullif(strip(F.col("unitsshort")), F.lit("")))
    freq = F.upper(strip(F.coalesce(F.col("f"), F.lit(""))))
    reason = (F.when(F.col("reject_reason").isNotNull(), F.col("reject_reason"))
              .when(unit.isNull(), "no_unit")
              .when(~freq.isin("", "H"), "not_hourly"))
    return series.withColumns({"unit": unit, "reject_reason": reason})


def read_item(item: Column | str) -> Column:
    """Struct (period, value) of one data item: a pair or an object."""
    period = F.coalesce(
        F.try_variant_get(item, "$[0]", "string"),
        *[F.nullif(F.try_variant_get(item, f"$.{k}", "string"), F.lit(""))
          for k in ("period", "timestamp", "date")])
    value = F.coalesce(F.try_variant_get(item, "$[1]", "string"),
                       F.try_variant_get(item, "$.value", "string"))
    return F.struct(period.alias("period"), parse_numeric(value).alias("value"))


def explode_observations(series: DataFrame, keep: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Array items (pairs or objects) to ``period, ts, value, pos`` rows.

    A null period or a non-numeric value is skipped. A numeric value under an
    unreadable period stays with a null ``ts``: it makes its series unusable.
    """
    items = series.select(*keep, F.posexplode("data").alias("pos", "item"))
    read = compute_once(items, {"_read": read_item("item")})
    rows = read.where("_read.period is not null and _read.value is not null").select(
        *keep, "pos", "_read.period", "_read.value")
    return rows.withColumn("ts", parse_period(F.col("period")))
