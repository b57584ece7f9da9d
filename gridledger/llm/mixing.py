"""Mixing sources to target weights by systematic sampling, in DataFrame functions alone.

Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share the words
of the whole input. A target stops at ``MOST`` times its source's size and the
excess is shared again by weight. Every document of a source is expected
``target / source size`` times; the expected copies are summed up within the
source, one random offset is added, and a document is emitted once for every
whole number its interval crosses. Documents of like size stand next to each
other in that sum, so the words taken follow the target closely.

The sum is taken in chunks of (source, size class, hash), with chunk totals as
offsets: no source is one task. Rows equal in all columns are counted first.
Reruns agree. Null and empty texts have no words: they stand in the sum, and
take nothing. A source without words has the target zero and no copies.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridledger.llm import common
from gridledger.operators.ranking import number_rows

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 11


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, none, source_size) with target: shares by weight, capped, the excess shared again.

    A share is ``level * weight``; the level rises until no uncapped source exceeds
    its cap. Each step is one aggregation.
    """
    numbered = number_rows(sizes, [], [F.col("source").asc()],
                           [("_none", F.col("none"), True), ("_head", F.substring("source", 1, 2), True)], "rank")
    choice = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = common.checkpointed(numbered.withColumn("weight", choice).withColumn("cap", F.col("source_size") * most).drop("rank"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, below = None, F.lit(False)
    while True:
        held, rest = sources.agg(F.sum(F.when(below, F.col("cap"))), F.sum(F.when(~below, F.col("weight")))).first()
        now = (total - (held or 0)) / rest if rest else level
        if now == level or now is None:
            break
        level = now
        below = F.col("cap") < F.col("weight") * F.lit(level)
    share = F.col("weight") * F.lit(float(level or 0))
    return sources.withColumn("target", F.least(F.col("cap").cast("double"), share)).drop("weight", "cap")


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row per distinct row: key1, key2, doc_id, size, source_size, target, repeats and emitted copies of all repeats."""
    key1, key2 = common.row_keys(docs)
    size = F.coalesce(F.regexp_count("text", F.lit(common.TOKEN)), F.lit(0)).cast("long")
    slim = docs.select(key1.alias("key1"), key2.alias("key2"), F.col("doc_id"), size.alias("size"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("source").isNull().alias("none"))
    counted = common.checkpointed(slim.groupBy(*slim.columns).agg(F.count("*").alias("repeats")))
    rows = counted.agg(F.sum("repeats")).first()[0] or 0
    sizes = counted.groupBy("source", "none").agg(F.sum(F.col("size") * F.col("repeats")).alias("source_size"))
    shares = targets(sizes, weights, most)
    salts = max(1, math.ceil(math.sqrt(rows) / 16))
    chunks = ["source", "none", "size_class", "salt"]
    chunked = (counted.withColumn("size_class", F.floor(F.log2(F.col("size") + 1)).cast("int"))
               .withColumn("salt", F.pmod(F.xxhash64(F.lit(seed), "key1"), F.lit(salts))))
    earlier = Window.partitionBy("source", "none").orderBy("size_class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (chunked.groupBy(*chunks).agg(F.sum("repeats").alias("rows"))
               .withColumn("offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).drop("rows")
               .join(shares, ["source", "none"]))
    inside = Window.partitionBy(*chunks).orderBy("size", "key1", "key2").rowsBetween(Window.unboundedPreceding, -1)
    local = chunked.withColumn("local", F.coalesce(F.sum("repeats").over(inside), F.lit(0)))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    start = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "source", "none"), 11) / F.lit(float(1 << 53))
    first = F.col("offset") + F.col("local")
    return (local.join(offsets, chunks).withColumn("each", each).withColumn("start", start).withColumn("first", first)
            .select("key1", "key2", "doc_id", "size", "source_size", "target", "repeats", "each", "start", "first"))


def _crossed(place) -> object:
    """Whole numbers crossed by the row at ``place`` of its source."""
    return F.least(F.floor(F.col("each") * (place + 1) + F.col("start")) - F.floor(F.col("each") * place + F.col("start")),
                   F.ceil("each")).cast("long")


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row."""
    rows = plan(docs, **options).withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)))
    return (rows.withColumn("copies", _crossed(F.col("first") + F.col("repeat")))
            .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: every row as often as it is emitted."""
    rows = plan(docs, **options).withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("repeats") - 1)))
    copies = (rows.withColumn("copies", _crossed(F.col("first") + F.col("repeat"))).where("copies > 0")
              .select("key1", "key2", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("col"))
    copies = copies.toDF(*common.fresh(docs, "_copy1", "_copy2"))
    key1, key2, number = common.fresh(docs, "key1", "key2", "number")
    keys = common.row_keys(docs)
    first = F.row_number().over(Window.partitionBy(key1, key2).orderBy(key1))
    once = docs.withColumns({key1: keys[0], key2: keys[1]}).withColumn(number, first).where(F.col(number) == 1)
    joined = once.join(copies, (once[key1] == copies[copies.columns[0]]) & (once[key2] == copies[copies.columns[1]]))
    return joined.select(*(once[common.quoted(c)] for c in docs.columns))
