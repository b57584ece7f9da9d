"""Vector codes by member-resident Lloyd rounds over the parts of the vectors.

Components become integers, vectors are cut into ``PARTS`` consecutive parts, and each part
position has a codebook of ``ENTRIES`` integer vectors. The rows of the work are parts. They
are partitioned by (position, entry, salt) and stay with their owner: a round sums the
members where they are, a few bounded rows for each partition leave, and the new entries
(``ENTRIES`` vectors, whatever the table's size) go back to the owners. Members find their
nearest entry in place; only parts whose entry changes go through the next shuffle, the
others are read from the cached partition they are in. Salts split an entry that holds
many parts. Cached partitions have their whole lineage, so a lost executor costs time only.

Rows: vectors that are null, empty, hold null or non-finite components, or have another
length than that of the smallest id are dropped, and so are those with a component so large
that the error of a vector of this length would not fit 64 bits (integers over
``sqrt(2^63 / length) / 2``, some 4 * 10^8 for 64 components). A length that is no multiple of
``PARTS`` is cut at floor(part * length / PARTS). Null ids come last. Repeated ids and
repeated rows are vectors like any other; among equal ids the content decides which comes
first. Fewer vectors than entries make smaller codebooks. An empty table gives no rows. The
id, vector and label columns are arguments; other columns are not read.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.llm import common

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Members of one (position, entry, salt), should all parts of a position have one entry.
MEMBERS = 1024
#: Parts compared with a codebook in one step.
STEP = 4096


@dataclass(frozen=True)
class Codebooks:
    """Entries of every position; parts shorter than the widest are padded with zeros."""

    entries: np.ndarray  # position, entry, component
    widths: list[int]

    def sha256(self) -> str:
        listed = (x for part, width in zip(self.entries.tolist(), self.widths, strict=True) for entry in part for x in entry[:width])
        return hashlib.sha256(",".join(map(str, listed)).encode()).hexdigest()

    def vector(self, code: str) -> list[float]:
        """The vector that a code stands for."""
        at = [int(code[i:i + 2], 16) for i in range(0, len(code), 2)]
        return [x / SCALE for p, e in enumerate(at) for x in self.entries[p, e, :self.widths[p]].tolist()]


def _nearest(entries: np.ndarray, position: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lowest of equals) and its squared distance for every part."""
    near, distance = np.zeros(len(parts), np.int32), np.zeros(len(parts), np.int64)
    for p in np.unique(position):
        mine = np.flatnonzero(position == p)
        for at in range(0, len(mine), STEP):
            rows = mine[at:at + STEP]
            far = np.stack([((parts[rows] - entry) ** 2).sum(axis=1) for entry in entries[p]], axis=1)
            best = far.argmin(axis=1)
            near[rows], distance[rows] = best, far[np.arange(len(rows)), best]
    return near, distance


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    position = batch.column(batch.schema.get_field_index("position")).to_numpy()
    part = batch.column(batch.schema.get_field_index("part")).flatten().to_numpy()
    return position, part.reshape(len(position), -1)


def assigned(parts: DataFrame, books: np.ndarray) -> DataFrame:
    """The parts with their nearest entry ``near`` and its squared ``distance``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near, distance = _nearest(books, *_rows(batch))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near), pa.array(distance)],
                                                 names=[*batch.schema.names, "near", "distance"])
    return parts.mapInArrow(run, ", ".join(f"{common.quoted(n)} {k}" for n, k in parts.dtypes) + ", near int, distance long")


def updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries after a round: floored means of the resident members; unused entries stay."""
    positions, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((positions * entries, width), np.int64)
        count = np.zeros(positions * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                position, parts = _rows(batch)
                cell = position.astype(np.int64) * entries + batch.column(batch.schema.get_field_index("entry")).to_numpy()
                np.add.at(total, cell, parts)
                count += np.bincount(cell, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
                              names=["cell", "n", "total"])

    found = (members.select("position", "entry", "part").mapInArrow(sums, "cell long, n long, total array<long>")
             .select("cell", "n", F.posexplode("total").alias("at", "x")).groupBy("cell", "at")
             .agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect())
    new = books.copy()
    for row in found:
        new[row["cell"] // entries, row["cell"] % entries, row["at"]] = int(row["x"]) // row["n"]
    return new


def _finite(vector: str):
    x = F.col(vector)
    return x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def fit(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | None = "label",
        rounds: int = ROUNDS, members: int = MEMBERS) -> tuple[Codebooks, DataFrame]:
    """Codebooks, and (vec_id, label, code, error) of every kept vector."""
    slim = vectors.select(F.col(common.quoted(vec_id)).alias("vec_id"), (F.col(common.quoted(label)) if label else F.lit(None).cast("int")).alias("label"),
                          F.col(common.quoted(vector)).cast("array<double>").alias("vector")).where(_finite("vector"))
    slim = slim.withColumns(dict(zip(("key1", "key2"), common.row_keys(slim), strict=True)))
    order = [F.col("vec_id").asc_nulls_last(), "key1", "key2"]
    first = slim.orderBy(*order).limit(1).collect()
    if not first:
        empty = slim.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
        return Codebooks(np.zeros((PARTS, 0, 0), np.int64), [0] * PARTS), empty
    length = len(first[0]["vector"])
    most = math.isqrt((1 << 63) // length) // 2
    whole = F.transform("vector", lambda x: F.floor(x * SCALE))
    kept = (slim.where(F.size("vector") == length).where(F.forall("vector", lambda x: F.abs(x) * SCALE < most))
            .withColumn("vector", whole))
    cuts = [p * length // PARTS for p in range(PARTS + 1)]
    widths = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    width = max(widths)
    start = kept.orderBy(*order).limit(ENTRIES).collect()
    if not start:
        return Codebooks(np.zeros((PARTS, 0, 0), np.int64), widths), kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    books = np.zeros((PARTS, len(start), width), np.int64)
    for e, row in enumerate(start):
        for p in range(PARTS):
            books[p, e, :widths[p]] = row["vector"][cuts[p]:cuts[p + 1]]
    salts = math.ceil(kept.count() / members)
    part = lambda p: F.concat(F.slice("vector", cuts[p] + 1, widths[p]),
                              F.array_repeat(F.lit(0).cast("long"), width - widths[p]))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))
    parts = (kept.withColumn("salt", salt)
             .select("vec_id", "label", "key1", "key2", "salt", F.posexplode(F.array(*map(part, range(PARTS)))).alias("position", "part")))
    columns = ["vec_id", "label", "key1", "key2", "salt", "position", "part"]
    moving = lambda seen: seen.select(*columns, F.col("near").alias("entry")).repartition("position", "entry", "salt")
    partitions = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    residents = moving(assigned(parts, books)).persist()
    for number in range(rounds):
        if number:
            seen = assigned(residents, books)
            stay = seen.where("near = entry").select(*columns, "entry")
            # Arrivals join a cached partition without another shuffle; the number of partitions stays.
            before, residents = residents, stay.union(moving(seen.where("near <> entry"))).coalesce(partitions).persist()
        books = updated(residents, books)
        if number:
            before.unpersist()
    codes = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("position") == p, F.col("near"))))), 2, "0") for p in range(PARTS)]
    copies = F.count(F.when(F.col("position") == 0, 1))
    coded = (assigned(residents, books).groupBy("vec_id", "label", "key1", "key2")
             .agg(F.concat(*codes).alias("code"), F.sum("distance").alias("total"), copies.alias("copies"))
             .select("vec_id", "label", "code", F.expr("total div copies").alias("error"), F.explode(F.expr("array_repeat(0, cast(copies as int))")).alias("copy"))
             .drop("copy"))
    coded = common.checkpointed(coded)
    residents.unpersist()
    return Codebooks(books, widths), coded


def with_label_error(coded: DataFrame) -> DataFrame:
    """Adds the error summed over the rows of equal labels (nulls are equal)."""
    totals = (coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
              .select(F.col("label").alias("of"), F.least("total", F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("label_error")))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")
