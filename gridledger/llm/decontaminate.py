"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of 13 consecutive words of a benchmark item, or a whole
shorter item. Patterns of one length share a table: the shift table tells for
the last block of words under the scan how far the scan may jump, blocks at a
pattern's end lead to the bucket of patterns with that suffix, and the words of
the patterns with the right first block are compared directly.

The benchmark is cut into segments that overlap by 12 words and dealt into
shards of a checked number of words; each shard is broadcast and scanned in a
pass of its own, and the passes add up the hit words of each row. So any
benchmark size works, and no document text is shuffled.

Rows: null and empty texts have no words and no hits. Items without words match
nothing; a null item id is written "null"; repeated items count once. Documents
are scanned row by row, so null and repeated ids and other columns do not matter.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridledger.llm import common

WINDOW = 13
#: Words of a pattern's block.
BLOCK = 2
#: Benchmark words of one broadcast (some 400 bytes of tables each).
SHARD_WORDS = 200_000
#: Words of one benchmark segment, next to the overlap.
SEGMENT = 2_000


class Table:
    """Shift table and suffix buckets of patterns of one length."""

    def __init__(self, length: int, patterns: dict[tuple, set[str]]) -> None:
        self.length, self.block = length, min(BLOCK, length)
        self.default = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple[list, set[str]]]]] = {}
        for words, items in patterns.items():
            for end in range(self.block, length + 1):
                block = words[end - self.block:end]
                self.shift[block] = min(self.shift.get(block, self.default), length - end)
            bucket = self.buckets.setdefault(words[-self.block:], {})
            bucket.setdefault(words[:self.block], []).append((list(words), items))

    def scan(self, words: list[bytes], hits: bytearray, found: set[str]) -> None:
        """Mark the words inside occurrences and collect the items they belong to."""
        length, block, shift, default, buckets = self.length, self.block, self.shift, self.default, self.buckets
        end, n = length, len(words)
        while end <= n:
            suffix = tuple(words[end - block:end])
            jump = shift.get(suffix, default)
            if jump:
                end += jump
                continue
            start = end - length
            for pattern, items in buckets[suffix].get(tuple(words[start:start + block]), ()):
                if words[start:end] == pattern:
                    hits[start:end] = b"\1" * length
                    found |= items
            end += 1


def tables_of(segments: list[tuple[str, list[bytes]]], window: int = WINDOW) -> list[Table]:
    """Tables by pattern length of (item, words) segments."""
    patterns: dict[int, dict[tuple, set[str]]] = {}
    for item, words in segments:
        length = min(window, len(words))
        for at in range(len(words) - length + 1) if length else ():
            patterns.setdefault(length, {}).setdefault(tuple(words[at:at + length]), set()).add(item)
    return [Table(length, found) for length, found in sorted(patterns.items())]


def segments_of(benchmark: DataFrame, window: int = WINDOW, size: int = SEGMENT) -> DataFrame:
    """(item, words): overlapping slices of at most ``size + window - 1`` words of every item."""
    words = F.regexp_extract_all(common.lower_ascii(F.col("text")), F.lit(common.WORD), F.lit(0))
    item = F.coalesce(F.col("item_id").cast("string"), F.lit("null"))
    slim = benchmark.select(item.alias("item"), words.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(size))
    return (slim.withColumn("start", F.explode(starts))
            .select("item", F.slice("words", F.col("start") + 1, size + window - 1).alias("words")).distinct())


def _shards(benchmark: DataFrame, window: int, shard_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Segments shard by shard, each of at most about ``shard_words`` words."""
    segments = segments_of(benchmark, window, min(SEGMENT, shard_words))
    total = segments.agg(F.sum(F.size("words"))).first()[0] or 0
    count = math.ceil(total / shard_words)
    dealt = lambda n: F.pmod(F.xxhash64("item", "words"), F.lit(n))
    while count > 1 and segments.groupBy(dealt(count)).agg(F.sum(F.size("words")).alias("n")).agg(
            F.max("n")).first()[0] > 2 * shard_words:
        count *= 2
    for shard in range(count):
        part = segments if count == 1 else segments.where(dealt(count) == shard)
        yield [(r.item, [w.encode() for w in r.words]) for r in part.collect()]


def _scan(shard, window: int, text: int, keep: list[int], names: list[str], first: bool):
    """Pass over one shard: rows keep the columns ``keep`` and get n_words, n_hit, marks and items."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_of(shard.value, window) if shard is not None else []
        for batch in batches:
            counts, sums, marks, lists = [], [], [], []
            before = None if first else [batch.column(batch.num_columns - i).to_pylist() for i in (2, 1)]
            for n, value in enumerate(batch.column(text).to_pylist()):
                words = common.words_of(value)
                hits, found = bytearray(len(words)), set()
                if before and before[0][n] is not None:
                    hits, found = bytearray(before[0][n]), set(before[1][n])
                for table in tables:
                    table.scan(words, hits, found)
                counts.append(len(words))
                sums.append(sum(hits))
                marks.append(bytes(hits) if found else None)
                lists.append(sorted(found))
            columns = [pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(marks, pa.binary()),
                       pa.array(lists, pa.list_(pa.string()))]
            yield pa.record_batch([*(batch.column(i) for i in keep), *columns], names=names)
    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
         keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row (default all), with n_words, n_hit, items and contaminated.

    New columns get a leading underscore where a kept one has their name.
    ``contaminated``: at least one word in twenty lies in an occurrence.
    """
    keep = docs.columns if keep is None else keep
    n_words, n_hit, items, contaminated, marks, body = common.fresh(
        docs, "n_words", "n_hit", "items", "contaminated", "hits", "body")
    shards = list(_shards(benchmark, window, shard_words)) or [None]
    rows = docs.select(*(common.quoted(c) for c in keep), F.col("text").cast("binary").alias(body))
    fields = list(rows.schema.fields)
    extra = [T.StructField(n_words, T.LongType()), T.StructField(n_hit, T.LongType()),
             T.StructField(marks, T.BinaryType()), T.StructField(items, T.ArrayType(T.StringType()))]
    for number, shard in enumerate(shards):
        last = number == len(shards) - 1
        kept = fields[:-1] if last else fields
        shared = None if shard is None else docs.sparkSession.sparkContext.broadcast(shard)
        names = [f.name for f in [*kept, *extra]]
        rows = rows.mapInArrow(_scan(shared, window, len(fields) - 1, list(range(len(kept))), names, number == 0),
                               T.StructType([*kept, *extra]))
    return (rows.withColumn(contaminated, (F.col(n_hit) > 0) & (F.col(n_hit) * 20 >= F.col(n_words)))
            .select(*(common.quoted(c) for c in keep), n_words, n_hit, items, contaminated))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows that are not contaminated, with the columns of ``docs``."""
    found = scan(docs, benchmark, **options)
    return found.where(~F.col(found.columns[-1])).select(*(common.quoted(c) for c in docs.columns))
