"""What filters remove together: an audit over all coalitions and orders of five filters.

Every document gets a mask of the filters that it fails. The masks of a part are counted (at
most 32 counts), and the counts give the removals of every coalition of filters. A filter's
step counts in an order are differences of two coalitions. Its Shapley value comes from
constrained least squares: an additive model is fitted to the removals of all coalitions
under the Shapley kernel's weights, with the sum of its terms held to the removals of all
filters together; the normal equations are solved in rationals, so the value is exact.

Texts are read once; what is shuffled is an id, a part, a mask and a 16-byte digest of the
text for each document. Copies are counted by digest and part before they meet, so a hot
text is a few rows.

Rows: a null text is empty, a null part is the empty string. Rows of one id are documents
each; equal texts of one id are not copies of a smaller id. A null id is smaller than none,
larger than none and has no labels. A document counts as good or toxic if any row of the labels says so.
An empty table gives no rows. Id, part and text are named by arguments; no other column is
read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridledger.llm import common

FILTERS = "ABCDE"
ALL = (1 << len(FILTERS)) - 1
LEAST_WORDS = 200
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
#: Bytes that only follow another in UTF-8.
FOLLOWING = bytes(range(0x80, 0xC0))
COPY = 1 << FILTERS.index("E")


def fails(text: bytes) -> int:
    """Mask of the filters A to D that a text fails; bytes split at ASCII white space."""
    words = text.split()
    n = len(words)
    short = n < LEAST_WORDS
    repeated = 100 * len(set(words)) < 50 * n
    capitals = len(text) - len(text.translate(None, CAPITALS))
    shouted = 100 * capitals > 3 * len(text.translate(None, FOLLOWING))
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return short | repeated << 1 | shouted << 2 | symbols << 3


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or b"" for t in batch.column(2).to_pylist()]
        yield pa.record_batch([
            batch.column(0), batch.column(1), pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
            pa.array([fails(t) for t in texts], pa.int32())], names=["id", "part", "digest", "mask"])


def mask_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", part: str = "lang", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters."""
    slim = docs.select(F.col(common.quoted(doc_id)).alias("id"), F.coalesce(F.col(common.quoted(part)).cast("string"), F.lit("")).alias("part"),
                       F.col(common.quoted(text)).cast("binary").alias("body"))
    marked = slim.mapInArrow(_marks, f"id {dict(slim.dtypes)['id']}, part string, digest binary, mask int")
    known = (labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id"))
             .agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
                  F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic")))
    rows = (marked.join(known, "id", "left")
            .groupBy("id", "part", "digest", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
            .agg(F.count("*").alias("n")))
    with_id = F.col("id").isNotNull()
    # Documents of one text and part, and those of the smallest id among them.
    texts = rows.groupBy("digest", "part", "mask", with_id.alias("known")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
        F.min(F.when(with_id, F.struct("id", "n", "good", "toxic"))).alias("first"))
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    is_first = F.coalesce(F.col("first.id") == smallest, F.lit(False))
    sole = {"n": F.col("first.n"), "good": F.col("first.n") * F.col("first.good"), "toxic": F.col("first.n") * F.col("first.toxic")}
    own = {k: F.when(~F.col("known"), F.col(k)).when(is_first, v).otherwise(0) for k, v in sole.items()}
    texts = texts.select("part", "mask", "n", "good", "toxic", *(v.alias(f"own_{k}") for k, v in own.items()))
    split = F.array(F.struct("mask", *(F.col(f"own_{k}").alias(k) for k in own)),
                    F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), *((F.col(k) - F.col(f"own_{k}")).alias(k) for k in own)))
    return (texts.select("part", F.inline(F.filter(split, lambda x: x["n"] > 0)))
            .groupBy("part", "mask").agg(*(F.sum(k).alias(k) for k in own)))


def removals(counts: dict[int, int]) -> list[int]:
    """Documents that each coalition of filters removes, by its bits."""
    return [sum(n for mask, n in counts.items() if mask & coalition) for coalition in range(ALL + 1)]


def shapley(value: list[int]) -> list[Fraction]:
    """Shapley values of a game with ``value[0] == 0`` by kernel-weighted least squares under efficiency, exactly."""
    n = len(value).bit_length() - 1
    left = [[Fraction(0)] * (n + 2) for _ in range(n + 1)]
    for coalition in range(1, len(value) - 1):
        size = coalition.bit_count()
        weight = Fraction(n - 1, comb(n, size) * size * (n - size))
        inside = [i for i in range(n) if coalition >> i & 1]
        for i in inside:
            left[i][n + 1] += weight * value[coalition]
            for j in inside:
                left[i][j] += weight
    for i in range(n):
        left[i][n] = left[n][i] = Fraction(1)  # the multiplier of sum(values) = value of all
    left[n][n + 1] = Fraction(value[-1])
    for at in range(n + 1):
        pivot = next(r for r in range(at, n + 1) if left[r][at])
        left[at], left[pivot] = left[pivot], left[at]
        left[at] = [x / left[at][at] for x in left[at]]
        for r in range(n + 1):
            if r != at and left[r][at]:
                left[r] = [x - left[r][at] * y for x, y in zip(left[r], left[at], strict=True)]
    return [row[n + 1] for row in left[:n]]


def steps(counts: list[dict]) -> Iterator[dict]:
    """Counts of every step of every order from the mask counts of a part."""
    n, good, toxic = (removals({c["mask"]: c[k] for c in counts}) for k in ("n", "good", "toxic"))
    total = sum(c["n"] for c in counts)
    orders = list(permutations(range(len(FILTERS))))
    summed = [int(len(orders) * x) for x in shapley(n)]
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            removed = n[after] - n[before]
            yield {"filter_order": "".join(FILTERS[i] for i in order), "step": step, "kept": total - n[after], "removed": removed,
                   "redundant": n[1 << f] - removed, "unique_fails": n[ALL] - n[ALL ^ 1 << f],
                   "good_lost": good[after] - good[before], "toxic_lost": toxic[after] - toxic[before], "shapley": summed[f]}
            before = after


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pylist([{"part": row["part"], **s} for s in steps(row["counts"])], schema=SCHEMA)


SCHEMA = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32())]
                   + [(k, pa.int64()) for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")])


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """A row for every part, order of the filters and step."""
    counts = mask_counts(docs, labels, **columns)
    return (counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
            .mapInArrow(_audit, "part string, filter_order string, step int, kept long, removed long, redundant long, "
                                "unique_fails long, good_lost long, toxic_lost long, shapley long"))
