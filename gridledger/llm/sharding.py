"""Two-pass external shuffle into shards of equal row counts, in DataFrame functions alone.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash of
the whole row and its repeat number. Pass two puts every bucket in a fixed order
and shuffles it (``shuffle`` is a seeded Fisher-Yates pass). Bucket sizes become
offsets, so each row has a place in one global permutation; place ``p`` goes to
shard ``p mod shards`` and slot ``p div shards``: counts differ by at most one and
slots have no gaps. Only identities are shuffled; a row is read once more to be
written at its place.

Rows that are equal in all columns are counted before the first shuffle and
numbered afterwards, so no key, source or group of copies is ever one task.
Reruns on the same rows agree, however the input files are split. Null ids,
null and empty texts and repeated rows are rows like any other; an empty table
gives no rows.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.llm import common

SHARDS = 8
SEED = 7


def bucket_count(rows: int) -> int:
    """Buckets grow with the square root of the rows: 10^6 rows give 250 of 4,000, 3 * 10^10 give 43,000 of 700,000."""
    return max(1, math.ceil(math.sqrt(rows) / 4))


def places(docs: DataFrame, columns: dict[str, Column] | None = None, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(key1, key2, columns..., shard, slot): a place for every row; the keys are ``common.row_keys``."""
    columns = columns or {}
    key1, key2 = common.row_keys(docs)
    slim = docs.select(key1.alias("key1"), key2.alias("key2"), *(c.alias(n) for n, c in columns.items()))
    counted = common.checkpointed(slim.groupBy(*slim.columns).agg(F.count("*").alias("repeats")))
    rows = counted.agg(F.sum("repeats")).first()[0] or 0
    buckets = bucket_count(rows)
    scattered = (counted.withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
                 .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key1", "key2", "repeat"), F.lit(buckets))))
    record = F.struct("key1", "key2", "repeat", *columns)
    shuffled = (scattered.repartition(buckets, "bucket").groupBy("bucket")
                .agg(F.sort_array(F.collect_list(record)).alias("records"))
                .sortWithinPartitions("bucket")
                .select("bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("at", "record")))
    shuffled = common.checkpointed(shuffled)
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (shuffled.groupBy("bucket").agg(F.count("*").alias("rows"))
               .select("bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset")))
    place = F.col("offset") + F.col("at")
    return (shuffled.join(offsets, "bucket")
            .select("record.key1", "record.key2", *(F.col(f"record.{n}") for n in columns),
                    F.pmod(place, F.lit(shards)).cast("int").alias("shard"),
                    F.floor(place / shards).cast("long").alias("slot")))


def assigned(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """All rows and columns of ``docs`` with their shard and slot (named ``_shard`` and so on where taken)."""
    key1, key2, shard, slot, number = common.fresh(docs, "key1", "key2", "shard", "slot", "number")
    at = places(docs, shards=shards, seed=seed).toDF("place1", "place2", "its_shard", "its_slot")
    at = at.toDF(*common.fresh(docs, *(f"_place_{n}" for n in range(4))))
    keys = common.row_keys(docs)
    first = F.row_number().over(Window.partitionBy(key1, key2).orderBy(key1))
    once = docs.withColumns({key1: keys[0], key2: keys[1]}).withColumn(number, first).where(F.col(number) == 1)
    joined = once.join(at, (once[key1] == at[at.columns[0]]) & (once[key2] == at[at.columns[1]]))
    return joined.select(*(once[common.quoted(c)] for c in docs.columns),
                         at[at.columns[2]].alias(shard), at[at.columns[3]].alias(slot))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, rows_per_file: int = 1_000_000) -> None:
    """Write every shard as a folder of Parquet files whose rows and names follow the slots."""
    placed = assigned(docs, shards, seed)
    shard, slot = placed.columns[-2:]
    part, = common.fresh(placed, "part")
    (placed.withColumn(part, F.floor(F.col(slot) / rows_per_file)).repartition(shard, part)
     .sortWithinPartitions(shard, part, slot).drop(part).write.partitionBy(shard).parquet(path))
