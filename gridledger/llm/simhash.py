"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints of 64 bits link at up to ``radius`` differing bits. Every bit
position gets a vector of ``radius + 1`` bits; table ``v`` keeps the positions
whose vector has an odd inner product with ``v``. The vectors of at most
``radius`` differing positions leave some ``v`` orthogonal to all of them, so
every pair within the radius agrees on the kept bits of some table: no pair is
missed. Equal fingerprints are one class and are never paired.

Within a bucket only a spanning forest of its links is emitted. Buckets of more
than ``BLOCK`` fingerprints are cut into blocks, and every pair of blocks is a
task of its own, so no bucket is gathered whole.

Rows: null and empty texts have the fingerprint zero and link like any other.
Null ids take part; a component's id is its smallest id that is not null.
Repeated rows are one class. Other columns are ignored (``fingerprints``,
``near_duplicates``) or kept as they are (``keep_one``).
"""
from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridledger.llm import common

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Fingerprints of one bucket compared in one step.
BLOCK = 4096
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values (seed 42) of the word shingles, as an unsigned integer."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    digest = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(words) - width + 1
    for at in range(0, n, CHUNK):
        upto = min(at + CHUNK, n)
        pieces = zip(starts[at:upto].tolist(), ends[at + width - 1:upto + width - 1].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in pieces), np.uint64, upto - at)
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprint_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.array(values, np.uint64).view(np.int64))],
                                  names=["doc_id", "row_key", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, fp): the fingerprint as a signed long; ``row_key`` tells texts of one id apart."""
    slim = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_key"), F.col("text").cast("binary"))
    return slim.mapInArrow(_fingerprint_batches(shingle), "doc_id long, row_key long, fp long")


def masks(radius: int = RADIUS, seed: int = SEED) -> list[int]:
    """Bit masks of the covering tables, as unsigned integers.

    The 64 position vectors run through all values but zero equally often, in
    seeded order, so each table keeps about half of the bits.
    """
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(64)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(first, member) for each linked group of distinct fingerprints; links may pass through others."""
    left, out = values, []
    while len(left) > 1:
        first, left = left[0], left[1:]
        queue = [first]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                queue.extend(left[near])
                out.extend((first, x) for x in left[near])
                left = left[~near]
    return out


class _Buckets:
    """Rows sorted by (table, key): pairs linked in small buckets, members of large ones with their block."""

    def __init__(self, radius: int, block: int) -> None:
        self.radius, self.block = radius, block
        self.open = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        self.large, self.blocks = None, 0  # key of the large bucket being let go, its blocks so far
        self.links: list[tuple[int, int]] = []
        self.members: list[tuple] = []

    def add(self, columns: list[np.ndarray]) -> None:
        table, key, fp = (np.concatenate(pair) for pair in zip(self.open, columns, strict=True))
        cuts = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
        self._close(table, key, fp, starts[:-1], ends[:-1])
        tail = slice(starts[-1], len(fp))
        if len(fp) - starts[-1] > self.block:  # too large to hold: whole blocks leave now
            whole = (len(fp) - starts[-1]) // self.block * self.block
            self._leave((table[-1], key[-1]), fp[tail][:whole])
            tail = slice(starts[-1] + whole, len(fp))
        self.open = [table[tail], key[tail], fp[tail]]

    def end(self) -> None:
        if len(self.open[2]):
            self._close(*self.open, np.array([0]), np.array([len(self.open[2])]))

    def _close(self, table, key, fp, starts, ends) -> None:
        sizes = ends - starts
        two = starts[sizes == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= self.radius
        self.links.extend(zip(fp[two][near], fp[two + 1][near], strict=True))
        more = sizes > 2
        if self.large is not None and len(starts):  # only the first bucket can go on with a large one
            more[0] = True
        for s, e in zip(starts[more], ends[more], strict=True):
            if self.large == (table[s], key[s]) or e - s > self.block:
                self._leave((table[s], key[s]), fp[s:e])
            else:
                self.links.extend(forest(fp[s:e], self.radius))

    def _leave(self, bucket: tuple, fp: np.ndarray) -> None:
        if bucket != self.large:
            self.large, self.blocks = bucket, 0
        number = self.blocks + np.arange(len(fp)) // self.block
        self.blocks = int(number[-1]) + 1
        self.members.append((fp, np.full(len(fp), bucket[0]), np.full(len(fp), bucket[1]), number))

    def batch(self) -> pa.RecordBatch:
        a = np.array([x for x, _ in self.links], np.uint64)
        b = np.array([x for _, x in self.links], np.uint64)
        none = np.full(len(a), -1, np.int64)
        columns = [[a.view(np.int64), *(m[0].view(np.int64) for m in self.members)],
                   [b.view(np.int64), *(m[0].view(np.int64) for m in self.members)],
                   *([none, *(m[i].astype(np.int64) for m in self.members)] for i in (1, 2, 3))]
        self.links, self.members = [], []
        return pa.record_batch([pa.array(np.concatenate(c)) for c in columns], names=["a", "b", "table", "key", "block"])


def _bucket_links(radius: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Buckets(radius, block)
        for batch in batches:
            if batch.num_rows:
                table, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                state.add([table, key, fp.view(np.uint64)])
                yield state.batch()
        state.end()
        yield state.batch()
    return run


def _block_links(radius: int):
    def run(pdf):
        values = np.unique(pdf["fp"].to_numpy().view(np.uint64))
        found = np.array(forest(values, radius), np.uint64).reshape(-1, 2).view(np.int64)
        return type(pdf)({"a": found[:, 0], "b": found[:, 1]})
    return run


def links(classes: DataFrame, radius: int = RADIUS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints ``fp`` within the radius, none between separate groups."""
    keyed = (classes.select("fp", F.posexplode(F.array(*(
                F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64))) for m in masks(radius, seed)))))
             .select(F.col("pos").alias("table"), F.col("col").alias("key"), "fp")
             .repartition("table", "key").sortWithinPartitions("table", "key", "fp"))
    found = common.checkpointed(keyed.mapInArrow(
        _bucket_links(radius, block), "a long, b long, table long, key long, block long"))
    small = found.where("block < 0").select("a", "b")
    large = found.where("block >= 0").select("table", "key", "block", F.col("a").alias("fp"))
    blocks = large.groupBy("table", "key").agg((F.max("block") + 1).alias("blocks"))
    paired = (large.join(blocks, ["table", "key"])
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .select("table", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp"))
    rest = paired.groupBy("table", "key", "i", "j").applyInPandas(_block_links(radius), "a long, b long")
    return small.unionByName(rest)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(doc_id, row_key, fp, root, component_id) for every row.

    ``root`` names the component by a fingerprint, ``component_id`` by its smallest id that is not null.
    """
    prints = common.checkpointed(fingerprints(docs, shingle))
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = common.components(links(classes.select("fp"), radius, seed))
    rooted = (classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group: the row with the smallest id (nulls last), then of the smallest text key.

    Columns stay as they are; of equal rows one stays.
    """
    return kept_first(docs, near_duplicates(docs, **options))


def kept_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The first row of each root of ``grouped`` (doc_id, row_key, root), in the order of ``keep_one``."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    first = grouped.groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.row_key")
    key, number = common.fresh(docs, "row_key", "row_number")
    left = docs.withColumn(key, F.xxhash64("text"))
    first = first.toDF("first_id", "first_key")
    kept = left.join(first, left["doc_id"].cast("long").eqNullSafe(first["first_id"])
                     & left[key].eqNullSafe(first["first_key"]), "left_semi")
    only = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(key))
    return kept.withColumn(number, only).where(F.col(number) == 1).select(*(common.quoted(c) for c in docs.columns))
