"""Price extracts: archives, header variants, typed rows, error bodies."""
from __future__ import annotations

import codecs
import csv
import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition

from gridledger.functions import fixed_values as fv
from gridledger.functions.plan import compute_once
from gridledger.functions.numbers import parse_opt_int, parse_price
from gridledger.functions.text import squeeze, strip
from gridledger.functions.times import parse_price_ts
from gridledger.sources.landed import (
    BATCH_BYTES, BATCH_ROWS, CHUNK, DAMAGED, UNREADABLE, ArchiveReader, chunks, merged, opened, read_archives)

FIELDS = tuple(field for field, _ in fv.PRICE_COLUMNS)
ARCHIVE_SCHEMA = ("path string, member string, row_no int, " + ", ".join(f"{f} string" for f in FIELDS)
                  + ", reject_reason string, bodies array<string>")
#: Python's white space, which is trimmed from cells.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


@lru_cache(10_000)
def normal_header(name: str) -> str:
    return re.sub(r"[^A-Z0-9]+", "_", name.strip().upper()).strip("_")


def _logical(find) -> list[Column]:
    """One trimmed text column per logical field: first non-empty alias."""
    return [F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in found]).alias(field)
            if (found := [c for c in (find(a) for a in aliases) if c is not None])
            else F.lit(None).cast("string").alias(field)
            for field, aliases in fv.PRICE_COLUMNS]


def normalize_price_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Wide rows with any accepted headers to the nine logical text fields.

    Two headers that normalise to the same name: the later one counts. ``keep``
    names extra columns (a file path, a row id) carried through unchanged.
    """
    present = {normal_header(c): c for c in df.columns if c not in keep}
    fields = _logical(lambda a: F.col(f"`{present[a]}`").cast("string") if a in present else None)
    return df.select(*keep, *fields)


def typed_price_rows(rows: DataFrame) -> DataFrame:
    """Parse boundaries, price and operating fields; text fields stay as they are."""
    return compute_once(rows, {
        "start_ts": parse_price_ts(F.col("interval_start")),
        "end_ts": parse_price_ts(F.col("interval_end")),
        "price_value": parse_price(F.col("price")),
        "hour": parse_opt_int(F.col("operating_hour")),
        "interval_no": parse_opt_int(F.col("operating_interval")),
    })


class ArchiveLimits(NamedTuple):
    """Optional limits of one archive; none by default (``fv.ARCHIVE_MAX_*`` are the compatible ones)."""

    max_bytes: int | None = None
    max_members: int | None = None
    max_member_bytes: int | None = None


def _over(value: int, limit: int | None) -> bool:
    return limit is not None and value > limit


def _body(raw: bytes) -> str:
    for encoding in fv.CSV_ENCODINGS:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return ""


def _member_fault(members: list[zipfile.ZipInfo], tables: list[zipfile.ZipInfo], limits: ArchiveLimits) -> str | None:
    names = [m.filename.lower() for m in members]
    if _over(len(members), limits.max_members):
        return "too_many_members"
    if any(n[:1] in ("/", "\\") or ".." in n.replace("\\", "/").split("/") for n in names):
        return "unsafe_path"
    if not tables:
        return "xml_only" if any(n.endswith(".xml") for n in names) else "no_csv"
    if len(tables) > 1:
        return "multiple_csv"
    return "member_too_large" if _over(tables[0].file_size, limits.max_member_bytes) else None


def _encoding(archive: zipfile.ZipFile, member: zipfile.ZipInfo) -> str | None:
    """The first accepted encoding that the whole member has; this pass tests its checksum too."""
    decoders = {e: codecs.getincrementaldecoder(e)() for e in fv.CSV_ENCODINGS if e != "utf-8-sig"}

    def alive(chunk: bytes, final: bool) -> None:
        for name in list(decoders):
            try:
                decoders[name].decode(chunk, final)
            except UnicodeDecodeError:
                del decoders[name]

    for chunk in chunks(archive, member):
        alive(chunk, False)
    alive(b"", True)
    return next(iter(decoders), None)


def _reject(path: str, reason: str, bodies: list[str] | None = None) -> list[tuple]:
    return [(path, None, 0, *(None for _ in FIELDS), reason, bodies)]


_ARROW = pa.schema([("path", pa.string()), ("member", pa.string()), ("row_no", pa.int32()), *((f, pa.string()) for f in FIELDS),
                    ("reject_reason", pa.string()), ("bodies", pa.list_(pa.string()))])


def _batched(items: Iterator[list[tuple] | pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of many small archives as batches, between those that come as batches."""
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    for item in items:
        if isinstance(item, pa.RecordBatch):
            yield item
            continue
        held += item
        size += sum(len(cell) for row in item for cell in (*row[3:-1], *(row[-1] or ())) if cell)
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _small_rows(archive: zipfile.ZipFile, member: zipfile.ZipInfo, path: str) -> list[tuple]:
    """Records of a member of ``SMALL`` bytes at most, which is read once; an Arrow reader would cost more than its records do."""
    text, raw = None, archive.read(member)
    for encoding in fv.CSV_ENCODINGS:
        try:
            text = raw.decode(encoding)
            break
        except UnicodeDecodeError:
            continue
    if text is None:
        return _reject(path, "undecodable")
    csv.field_size_limit(2**31 - 1)
    records = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    if not records:
        return _reject(path, "no_header")
    at = {normal_header(name): n for n, name in enumerate(records[0])}
    places = [[at[a] for a in aliases if a in at] for _, aliases in fv.PRICE_COLUMNS]
    return [(path, member.filename, number,
             *(next((c for n in found if n < len(r) and (c := r[n].strip())), None) for found in places), None, None)
            for number, r in enumerate(records[1:], 1)]


def _fields(header: list[str], cells: list[pa.Array]) -> list[pa.Array]:
    """The logical fields: per row the first alias that is not empty; of equal headers the later one."""
    at = {normal_header(name): n for n, name in enumerate(header)}
    out = []
    for _, aliases in fv.PRICE_COLUMNS:
        found = [pc.utf8_trim(cells[at[a]], WHITE) for a in aliases if a in at]
        found = [pc.if_else(pc.equal(c, ""), pa.scalar(None, pa.string()), c) for c in found]
        out.append(pc.coalesce(*found) if found else pa.nulls(len(cells[0]), pa.string()))
    return out


def _table_rows(archive: zipfile.ZipFile, member: zipfile.ZipInfo, encoding: str, header: list[str],
                block: int) -> Iterator[tuple[list[int], list[pa.Array]]]:
    """(row numbers, cells) of a member's records; short and long records are padded and cut."""
    names = [f"c{n}" for n in range(len(header))]
    odd: dict[int, list[str]] = {}

    def keep_odd(row: pacsv.InvalidRow) -> str:
        found = next(csv.reader([row.text]), [])
        odd[row.number] = (found + [""] * len(names))[:len(names)]
        return "skip"

    with archive.open(member) as stream:
        reader = pacsv.open_csv(
            stream, pacsv.ReadOptions(use_threads=False, block_size=block, column_names=names,
                                      encoding="utf8" if encoding == "utf-8" else encoding),
            pacsv.ParseOptions(newlines_in_values=True, invalid_row_handler=keep_odd),
            pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False))
        number = 1  # of the next record; the header is the first
        for batch in reader:
            numbers = []
            for _ in range(batch.num_rows):
                while number in odd:
                    number += 1
                numbers.append(number)
                number += 1
            yield numbers, batch.columns
        rest = sorted(odd.items())
    if rest:
        yield [n for n, _ in rest], [pa.array(c, pa.string()) for c in zip(*(cells for _, cells in rest), strict=True)]


def _member_batches(archive: zipfile.ZipFile, member: zipfile.ZipInfo, path: str) -> Iterator[list[tuple] | pa.RecordBatch]:
    if member.file_size <= SMALL:
        yield _small_rows(archive, member, path)
        return
    encoding = _encoding(archive, member)
    if encoding is None:
        yield _reject(path, "undecodable")
        return
    with archive.open(member) as stream:
        text = io.TextIOWrapper(stream, encoding="utf-8-sig" if encoding == "utf-8" else encoding, newline="")
        csv.field_size_limit(2**31 - 1)  # a cell may be as long as its file
        header = next((r for r in csv.reader(text) if r), None)
    if header is None:
        yield _reject(path, "no_header")
        return
    block, given = CHUNK, 0
    while True:
        seen = 0
        try:
            for numbers, cells in _table_rows(archive, member, encoding, header, block):
                skip = min(len(numbers), max(0, given - seen))
                seen += len(numbers)
                numbers, cells = numbers[skip:], [c.slice(skip) for c in cells]
                if numbers and numbers[0] == 1:  # the header
                    numbers, cells, given = numbers[1:], [c.slice(1) for c in cells], given + 1
                if numbers:
                    n = len(numbers)
                    given += n
                    rows = [pa.array([path] * n), pa.array([member.filename] * n), pa.array([x - 1 for x in numbers], pa.int32()),
                            *_fields(header, cells), pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(rows, schema=_ARROW)
            return
        except pa.ArrowInvalid as fault:
            if "straddling" not in str(fault):
                raise
            block *= 8  # a record longer than the block; what was given is passed over


def archive_batches(stream, path: str, size: int,
                    limits: ArchiveLimits = ArchiveLimits()) -> Iterator[list[tuple] | pa.RecordBatch]:
    """Records of one archive as they stream; a rejected archive gives one row, with the text of an XML body."""
    if not size:
        yield _reject(path, "empty_response")
        return
    if _over(size, limits.max_bytes):
        yield _reject(path, "archive_too_large")
        return
    try:
        archive = zipfile.ZipFile(stream)
    except zipfile.BadZipFile:
        stream.seek(0)
        yield _reject(path, "bad_zip", [_body(stream.read(ERROR_BYTES))])
        return
    except DAMAGED:
        yield _reject(path, "corrupt_member")
        return
    try:
        members = [m for m in archive.infolist() if not m.is_dir()]
        tables = [m for m in members if m.filename.lower().endswith(".csv")]
        fault = _member_fault(members, tables, limits)
        if fault == "xml_only":
            yield _reject(path, fault, [_body(archive.read(m)) for m in members if m.filename.lower().endswith(".xml")])
        elif fault:
            yield _reject(path, fault)
        else:
            yield from _member_batches(archive, tables[0], path)
    except UNREADABLE:  # encrypted, or packed in an unknown way
        yield _reject(path, "unreadable_member")
    except DAMAGED:
        yield _reject(path, "corrupt_member")


#: Bytes of a member whose records are read as rows, without an Arrow reader.
SMALL = 1 << 16
#: Bytes kept of a body that is no archive.
ERROR_BYTES = 1 << 20


class PriceArchiveReader(ArchiveReader):
    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return merged(_batched(item for part in partition.value for item in self.batches(part)))

    def batches(self, part: tuple) -> Iterator[list[tuple] | pa.RecordBatch]:
        path, size = part
        limit = lambda name: int(self.options[name]) if self.options.get(name) else None
        with opened(path) as stream:
            yield from archive_batches(stream, path, size, ArchiveLimits(*map(limit, ArchiveLimits._fields)))


def read_price_archives(spark: SparkSession, path: str, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """Records of the landed archives under a path, as logical text fields; a rejected archive gives one row.

    Archives spread over the cluster, each is read twice as a stream (encoding and checksum, then records)
    and its header once; memory holds a batch. No content ends the job: empty, damaged, encrypted and
    undecodable archives are rejected by name. The row of a body that is XML (zipped or plain) carries its text.
    """
    options = {name: str(value) for name, value in limits._asdict().items() if value is not None}
    return read_archives(spark, PriceArchiveReader({"path": path, **options}), ARCHIVE_SCHEMA)


def price_archive_rows(archives: DataFrame, limits: ArchiveLimits = ArchiveLimits()) -> DataFrame:
    """As above for ``path, content`` rows of a table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple] | pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from archive_batches(io.BytesIO(content or b""), path, len(content or b""), limits)
    return archives.select("path", "content").mapInArrow(lambda batches: merged(_batched(run(batches))), ARCHIVE_SCHEMA)


def detect_price_errors(archives: DataFrame) -> DataFrame:
    """Error message of each rejected archive, null when its body names none."""
    found = F.filter(F.transform("bodies", price_error), lambda m: m.isNotNull())
    return archives.where("reject_reason is not null").select(
        "path", "reject_reason", F.get(found, F.lit(0)).alias("message"))


_NAMED_ERROR = r"(?is)<(?:ERR_DESC|ERROR_DESC|MESSAGE)>(.*?)</(?:ERR_DESC|ERROR_DESC|MESSAGE)>"


def price_error(body: Column) -> Column:
    """Error text of a returned XML body, null when the body is no error.

    The named description wins; otherwise an ERROR tag makes the whole
    tag-stripped text the message.
    """
    named = body.rlike(_NAMED_ERROR)
    summary = squeeze(F.regexp_replace(body, "<[^>]+>", " "))
    return (
        F.when(named, squeeze(F.regexp_extract(body, _NAMED_ERROR, 1)))
        .when(body.rlike(r"(?i)<(?:ERROR|ERR_CODE|ERR_DESC)\b"), summary)
    )
