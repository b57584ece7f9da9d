"""Landed ZIP archives, opened by path and read as streams.

The files under a path (a file or a folder, ``file:``, ``hdfs:``, ``s3a:`` and whatever else pyarrow opens), empty ones
included, are listed by tasks and stay a table, so the driver holds none of their names. Tasks deal them to parts: an archive
of ``SPLIT`` bytes or more is a part of its own, smaller ones share one, some ``FILES`` at most. Bodies never
lie in memory: an archive is opened at its end, and its members leave as Arrow batches.
"""
from __future__ import annotations

import math
import os
import pickle
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition

from gridledger.session import cut_lineage

#: Bytes of archives that make a part, and the number of empty ones that would (opening a file costs as much as its share).
SPLIT, FILES = 64 << 20, 500
#: Folders that a task lists at least and at most (some 200 tasks between), and files that a task deals to parts.
FOLDERS, LISTED = (8, 5_000), 20_000
#: Folders over which landed files are spread by their names.
SPREAD = 64
#: Bytes read at once, and rows and bytes of a batch.
CHUNK, BATCH_ROWS, BATCH_BYTES = 1 << 20, 20_000, 8 << 20
#: What a damaged, encrypted or oddly packed archive raises.
DAMAGED = (zipfile.BadZipFile, zipfile.LargeZipFile, zlib.error, EOFError, OSError, ValueError)
UNREADABLE = (RuntimeError, NotImplementedError)


def file_system(path: str) -> tuple[pafs.FileSystem, str, str]:
    """File system of a path, the path within it, and what goes before it to make a path again."""
    scheme, colon, rest = path.partition("://")
    if not colon:
        return pafs.LocalFileSystem(), path.removeprefix("file:"), "file:" if path.startswith("file:") else ""
    if scheme == "file":
        return pafs.LocalFileSystem(), rest, "file://"
    fs, inner = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs, inner, path[:len(path) - len(inner)] if path.endswith(inner) else f"{scheme}://"


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of every file under a path in the order of their names; hidden files are left out."""
    fs, inner, before = file_system(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
    return sorted((before + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


def entries(path: str) -> Iterator[tuple[str, int | None]]:
    """(path, bytes) of what lies in a folder, as it is found; a folder in it has no bytes. Hidden files are left out.

    A local folder is a stream; of another store pyarrow gives the whole folder at once.
    """
    fs, inner, before = file_system(path)
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(inner) as found:
            for f in found:
                if f.is_dir():
                    yield before + f.path, None
                elif f.is_file() and not f.name.startswith(("_", ".")):
                    yield before + f.path, f.stat().st_size
        return
    for f in fs.get_file_info(pafs.FileSelector(inner)):
        if f.type == pafs.FileType.Directory:
            yield before + f.path, None
        elif f.is_file and not f.base_name.startswith(("_", ".")):
            yield before + f.path, f.size


def listed_files(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """``path, size`` of every file under a path, and their number. Tasks list the folders, one level after another."""
    columns = "path string, size long"
    fs, inner, _ = file_system(path)
    kind = fs.get_file_info(inner).type
    if kind == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if kind == pafs.FileType.File:
        return spark.createDataFrame(listed(path), columns), 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = entries(folder)
                while held := list(islice(found, BATCH_ROWS)):
                    paths, sizes = zip(*held, strict=True)
                    yield pa.record_batch([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["path", "size"])

    folders, levels, number = spark.range(0, 1, 1, 1).select(F.lit(path).alias("path")), [], 0
    while True:
        level = cut_lineage(folders.mapInArrow(run, columns))
        levels.append(level.where("size is not null"))
        all_, files = level.agg(F.count("*"), F.count("size")).first()
        number, inside = number + files, all_ - files
        if not inside:
            break
        least, most = FOLDERS
        folders = level.where("size is null").select("path").repartition(math.ceil(inside / min(max(least, inside // 200), most)))
    out = levels[0]
    for more in levels[1:]:
        out = out.union(more)
    return out, number


@contextmanager
def opened(path: str):
    """The file as a seekable stream."""
    fs, inner, _ = file_system(path)
    with fs.open_input_file(inner) as stream:
        yield stream


def chunks(archive: zipfile.ZipFile, member: zipfile.ZipInfo) -> Iterator[bytes]:
    """Content of a member; its checksum is tested at the end."""
    with archive.open(member) as stream:
        while chunk := stream.read(CHUNK):
            yield chunk


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of many small archives put together."""
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= BATCH_ROWS or size >= BATCH_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def dealt(parts: Iterable[tuple[int, tuple]], split: int) -> Iterator[InputPartition]:
    """Neighbours with about ``split`` bytes together, from (bytes, part); each part counts for some bytes more."""
    held, size = [], 0
    for n, part in parts:
        n += split // FILES
        if held and size + n > split:
            yield InputPartition(held)
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield InputPartition(held)


class ArchiveReader:
    """Reads the parts of its partitions one after another; ``parts`` and ``batches`` say what a part is."""

    def __init__(self, options: dict) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.options = dict(options)

    def parts(self, path: str, size: int) -> list[tuple[int, tuple]]:
        return [(size, (path, size))]

    def batches(self, part: tuple) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def deal(self, files: Iterable[tuple[str, int]]) -> Iterator[InputPartition]:
        return dealt((p for path, size in files for p in self.parts(path, size)), self.split)

    def partitions(self) -> list[InputPartition]:
        """All of them, for a folder that one process lists."""
        return list(self.deal(listed(self.path)))

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from merged(b for part in partition.value for b in self.batches(part))


def read_archives(spark: SparkSession, reader: ArchiveReader, columns: str) -> DataFrame:
    """Rows of all archives under a reader's path, which is listed now.

    Tasks deal some ``LISTED`` files each to partitions; those are rows again and are spread over as many tasks. The driver holds their number.
    """
    files, number = listed_files(spark, reader.path)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (f for b in batches for f in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for partition in reader.deal(found):
            yield pa.record_batch([pa.array([pickle.dumps(partition.value)], pa.binary())], names=["partition"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for partition in batch.column(0):
                yield from reader.read(InputPartition(pickle.loads(partition.as_py())))

    spread = files.repartition(max(1, math.ceil(number / LISTED)), "path").sortWithinPartitions("path")
    partitions = cut_lineage(spread.mapInArrow(deal, "partition binary"))
    return partitions.repartition(max(1, partitions.count())).mapInArrow(read, columns)


def land_files(files: DataFrame, folder: str) -> None:
    """Write ``content`` (binary) of every row as the file ``path`` under a folder; a retried task writes the same files again.

    A file's name says in which of ``SPREAD`` folders it lies, so that many tasks can list them.
    """
    fs, top, _ = file_system(folder)
    for n in range(SPREAD):
        fs.create_dir(f"{top}/{n:02d}", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner, _ = file_system(folder)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{inner}/{zlib.crc32(path.encode()) % SPREAD:02d}/{path}") as out:
                    out.write(content or b"")
            yield pa.record_batch([batch.column(0)], names=["path"])

    files.select("path", "content").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
