"""Embedding near-duplicates by sorted projection passes.

Each pass hashes every distinct vector with ``BITS`` random hyperplanes, one bit
each, and sorts the vectors by the concatenated bits. Vectors are compared with
the next ones of the order: the order is cut into blocks of ``WINDOW`` vectors and a
block is compared with itself and the next block, so every vector meets at
least ``WINDOW`` neighbours and no group holds more than two blocks. A group emits
the pairs of a spanning forest of its verified links, and the union of all passes
gives the components. Direct links are then counted exactly inside components,
block against block, where only counts are emitted.

Bounded windows would miss links inside a run of more than two blocks of equal
hashes. There a run has an exact way: its blocks are compared in all pairs of
blocks, each pair in a task of its own.

The number of passes follows from the number of vectors: a pair at the threshold
shares the leading ``log2(n / WINDOW)`` bits with probability ``(1 - angle / pi)`` to
that power, and passes are added until a pair is missed with probability at most
``1 - RECALL``. Pairs nearer than the threshold are found more surely.

Equal vectors are one class before the first pass, so a very common vector is one
row; its copies count as links.

Rows: vectors that are null, zero or hold null or non-finite components link
with nothing. Vectors of different lengths never link. Null and repeated ids
are rows like any other: a component's id is its smallest id that is not null.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridledger.llm import common

THRESHOLD = 0.9
BITS = 62
WINDOW = 512
RECALL = 0.999
SEED = 6
#: Passes per round of jobs.
ROUND = 8


def passes_for(vectors: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met with probability ``recall``."""
    prefix = max(0.0, math.log2(max(1, vectors) / window))
    meet = (1 - math.acos(threshold) / math.pi) ** prefix
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))) if meet < 1 else 1


def keyed(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, k1, k2): rows with the 128-bit key of their vector, all null where it links with nothing."""
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))  # -0.0 equals 0.0
    odd = F.exists(plain, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = ~odd & (F.array_max(F.transform(plain, F.abs)) > 0)
    return (vectors.select(F.col("vec_id").cast("long"), F.when(good, plain).alias("v"))
            .withColumn("k1", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")))
            .withColumn("k2", F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(2), "v"))))


def _units(lists: list) -> np.ndarray:
    x = np.array(lists, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashes(numbers: list[int], bits: int, seed: int):
    """(pass, dim, code, node) for each vector and pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            by: dict[int, list[int]] = {}
            for n, v in enumerate(lists):
                by.setdefault(len(v), []).append(n)
            for dim, rows in by.items():
                x = _units([lists[n] for n in rows])
                for number in numbers:
                    if (number, dim) not in planes:
                        planes[number, dim] = np.random.default_rng([seed, number, dim]).standard_normal((dim, bits))
                    code = (x @ planes[number, dim] > 0) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))
                    yield pa.record_batch([pa.array(np.full(len(rows), k, np.int32)) for k in (number, dim)]
                                          + [pa.array(code), pa.array(ids[rows])], names=["pass", "dim", "code", "node"])
    return run


def forest(near: np.ndarray) -> list[tuple[int, int]]:
    """(first, member) of each linked group of a symmetric matrix of links."""
    left, out = np.ones(len(near), bool), []
    for first in range(len(near)):
        if left[first]:
            left[first] = False
            front = np.array([first])
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & left)
                left[front] = False
                out.extend((first, int(m)) for m in front)
    return out


def _group_links(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, node = _units(pdf["v"].tolist()), pdf["node"].to_numpy()
        found = np.array(forest(unit @ unit.T >= threshold), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[found[:, 0]], "b": node[found[:, 1]]})
    return run


def _group_counts(threshold: float):
    """Weighted links of the members of two blocks with each other, of one block within itself."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        unit, node, copies = _units(pdf["v"].tolist()), pdf["node"].to_numpy(), pdf["copies"].to_numpy()
        near = unit @ unit.T >= threshold
        np.fill_diagonal(near, False)
        if pdf["i"].iloc[0] != pdf["j"].iloc[0]:
            side = pdf["block"].to_numpy()
            near &= side[:, None] != side[None, :]
        return pd.DataFrame({"node": node, "near": near.astype(np.int64) @ copies})
    return run


def _one_round(classes: DataFrame, numbers: list[int], count: int, threshold: float, window: int, bits: int, seed: int) -> DataFrame:
    order = common.checkpointed(classes.select("node", "v").mapInArrow(
        _hashes(numbers, bits, seed), "pass int, dim int, code long, node long"))
    # Place in the order of the pass: leading bits cut it into chunks, chunk totals become offsets.
    cut = max(0, math.ceil(math.log2(max(1, count) / window)))
    keys = ["pass", "dim"]
    rows = order.withColumn("chunk", F.shiftright("code", bits - cut) if cut else F.lit(0).cast("long"))
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, "chunk").agg(F.count("*").alias("rows"))
               .withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows"))
    inside = F.row_number().over(Window.partitionBy(*keys, "chunk").orderBy("code", "node"))
    placed = common.checkpointed(
        rows.withColumn("local", inside).join(offsets, [*keys, "chunk"])
        .select(*keys, "code", "node", F.floor((F.col("offset") + F.col("local") - 1) / window).alias("block")))
    # Runs of equal hashes that reach over more than two blocks.
    runs = placed.groupBy(*keys, "code").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("high > low + 1")
    spread = (placed.join(runs, [*keys, "code"])
              .withColumn("other", F.explode(F.sequence(F.col("low"), F.col("high"))))
              .where(F.abs(F.col("other") - F.col("block")) > 1)
              .select(*keys, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node"))
    near = placed.select(*keys, F.explode(F.array(F.col("block"), F.col("block") - 1)).alias("i"), "node").withColumn("j", F.col("i") + 1)
    members = near.unionByName(spread).join(classes.select("node", "v"), "node")
    found = members.groupBy(*keys, "i", "j").applyInPandas(_group_links(threshold), "a long, b long")
    return common.checkpointed(found.distinct())


def links(classes: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW, bits: int = BITS, recall: float = RECALL,
          seed: int = SEED) -> DataFrame:
    """Pairs (a, b) that join the linked groups of the classes (node, v) that meet in some pass."""
    count = classes.count()
    passes = passes_for(count, threshold, window, recall)
    out = classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    for at in range(0, passes, ROUND):
        out = out.unionByName(_one_round(
            classes, list(range(at, min(at + ROUND, passes))), count, threshold, window, bits, seed))
    return out


def link_counts(classes: DataFrame, roots: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """(node, near): copies of the other classes linked directly. Links lie within components (node, root), which are
    compared in pairs of blocks; only counts leave a block."""
    members = classes.join(roots, "node")
    blocks = members.groupBy("root").agg(F.ceil(F.count("*") / window).alias("blocks"))
    dealt = (members.select("node", "root").join(blocks, "root")
             .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    return (dealt.join(classes.select("node", "v", "copies"), "node").groupBy("root", "i", "j")
            .applyInPandas(_group_counts(threshold), "node long, near long")
            .groupBy("node").agg(F.sum("near").alias("near")))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    ``n_links`` counts the other rows linked directly, equal vectors included. Of a
    component the row with its smallest id is kept; rows that repeat that id are kept too.
    """
    rows = keyed(vectors)
    valid = rows.where(F.col("k1").isNotNull())
    classes = common.checkpointed(valid.groupBy("k1", "k2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"))
        .withColumn("node", F.xxhash64("k1", "k2")))
    found = common.components(links(classes.select("node", "v"), threshold, **options))
    roots = common.checkpointed(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()))
    near = link_counts(classes.select("node", "v", "copies"), roots, threshold)
    rooted = (classes.drop("v").join(roots, "node", "left").join(near, "node", "left")
              .withColumn("root", F.coalesce("root", "node"))
              .withColumn("n_links", F.coalesce("near", F.lit(0)) + F.col("copies") - 1))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(ids, "root").select("k1", "k2", "n_links", "component_id")
    linked = valid.select("vec_id", "k1", "k2").join(labels, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(F.col("k1").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
