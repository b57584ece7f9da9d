"""Ordered selection per group.

Rank filters are written as ``row_number() <= k`` so Spark prunes each map
partition to k rows per group before the shuffle: a group holding a third of
the input sends a handful of rows per task. Where every row of a group must be
numbered, ``number_rows`` splits the group into ordered chunks.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          name: str | None = None) -> DataFrame:
    """First ``k`` rows of each group."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", name) if name else out.drop("_rank")


def first_seen(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Ordered de-duplication keeping the lowest position of each key."""
    return top_k(df, keys, [F.col(pos).asc()], 1)


def keep_last(observations: DataFrame, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """Same timestamp in one series: the last array element wins."""
    return observations.groupBy(*keys, "ts").agg(F.max_by("value", "pos").alias("value"))


def flag_duplicates(intervals: DataFrame, keys: Sequence[str], start: str = "start_ts") -> DataFrame:
    """Per group: rows, distinct starts and whether any start repeats."""
    per_start = intervals.groupBy(*keys, start).agg(F.count("*").alias("_n"))
    return per_start.groupBy(*keys).agg(
        F.sum("_n").alias("row_count"), F.count("*").alias("distinct_starts"),
        (F.max("_n") > 1).alias("has_duplicates"))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                chunk: Sequence[tuple[str, Column, bool]], name: str = "row_no") -> DataFrame:
    """Number all rows of each group from 1 without one task per group.

    ``chunk`` lists (alias, expression, ascending) columns that follow ``order``:
    rows of an earlier chunk precede rows of a later one. Chunk counts are summed
    first (partial aggregation), their running totals become offsets, and only
    rows of one chunk are ever sorted together. Chunk columns must not be null.
    """
    aliases = [alias for alias, _, _ in chunk]
    df = df.withColumns({alias: expr for alias, expr, _ in chunk})
    ordering = [F.col(a).asc() if up else F.col(a).desc() for a, _, up in chunk]
    before = Window.partitionBy(*keys).orderBy(*ordering).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*keys, *aliases).agg(F.count("*").alias("_count"))
               .withColumn("_offset", F.coalesce(F.sum("_count").over(before), F.lit(0)))
               .drop("_count"))
    local = F.row_number().over(Window.partitionBy(*keys, *aliases).orderBy(*order))
    return (df.withColumn("_local", local).join(offsets, [*keys, *aliases])
            .withColumn(name, F.col("_local") + F.col("_offset"))
            .drop("_local", "_offset", *aliases))


def number_sources(records: DataFrame, key: str = "question_id", pos: str = "pos",
                   chunk_size: int = 100_000) -> DataFrame:
    """``source-1..n`` in retrieval order."""
    out = number_rows(records, [key], [F.col(pos).asc()],
                      [("_chunk", F.floor(F.col(pos) / chunk_size), True)], "source_no")
    return out.withColumn("source_id", F.concat(F.lit("source-"), F.col("source_no")))


def cap_documents(docs: DataFrame, key: str = "question_id", pos: str = "pos",
                  accepted: str = "accepted", candidates: int | None = 12, documents: int | None = 6) -> DataFrame:
    """Candidates actually tried: the first ``candidates``, stopping once ``documents`` were accepted; None: all."""
    tried = docs if candidates is None else top_k(docs, [key], [F.col(pos).asc()], candidates)
    if documents is None:
        return tried
    before = Window.partitionBy(key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum(F.col(accepted).cast("int")).over(before), F.lit(0))
    return tried.withColumn("_done", done).where(F.col("_done") < documents).drop("_done")


def one_per_domain(docs: DataFrame, key: str = "question_id", pos: str = "pos", ok: str = "ok",
                   domain: str = "domain", candidates: int = 8, sources: int = 4) -> DataFrame:
    """First successful document per domain among 8 candidates, at most 4.

    A blank domain never counts as repeated.
    """
    good = top_k(docs, [key], [F.col(pos).asc()], candidates).where(F.col(ok))
    nth = F.row_number().over(Window.partitionBy(key, domain).orderBy(pos))
    fresh = good.withColumn("_nth", nth).where((F.col("_nth") == 1) | (F.col(domain) == ""))
    return top_k(fresh.drop("_nth"), [key], [F.col(pos).asc()], sources, "source_no")


def until_satisfied(attempts: DataFrame, key: str = "question_id", pos: str = "pos",
                    min_records: int = 1, require_primary: bool = True) -> DataFrame:
    """Attempts made before a question had enough records (and a primary one).

    Needs ``records`` and ``primary_records`` per attempt. The stopping point is
    the later of two first hits: the first primary record, found by a minimum,
    and the attempt where the running record count reaches ``min_records``, which
    only the first ``min_records`` contributing attempts can decide.
    """
    need = max(min_records, 1)
    gains = attempts.where(F.col("records") > 0).select(key, pos, "records", "primary_records")
    first = top_k(gains, [key], [F.col(pos).asc()], need)
    running = F.sum("records").over(Window.partitionBy(key).orderBy(pos)
                                    .rowsBetween(Window.unboundedPreceding, 0))
    enough = (first.withColumn("_sum", running).where(F.col("_sum") >= need)
              .groupBy(key).agg(F.min(pos).alias("_enough")))
    stops = enough
    stop = F.col("_enough")
    if require_primary:
        primary = (gains.where(F.col("primary_records") > 0)
                   .groupBy(key).agg(F.min(pos).alias("_primary")))
        stops = enough.join(primary, key)
        stop = F.greatest("_enough", "_primary")
    stops = stops.select(key, stop.alias("_stop"))
    return (attempts.join(stops, key, "left")
            .where(F.col("_stop").isNull() | (F.col(pos) <= F.col("_stop"))).drop("_stop"))


def rank_results(results: DataFrame, key: str = "question_id", pos: str = "pos",
                 score: str = "score", chunk_size: int = 100_000) -> DataFrame:
    """All results by score, equal scores in input order."""
    return number_rows(
        results, [key], [F.col(score).desc(), F.col(pos).asc()],
        [("_score_chunk", F.col(score), False),
         ("_pos_chunk", F.floor(F.col(pos) / chunk_size), True)], "result_rank")


def top_candidates(candidates: DataFrame, k: int | None = 30, key: str = "question_id") -> DataFrame:
    """Official first, then score, then dated; stable on first-seen position. Without ``k`` all are ranked."""
    order = [F.col("official").desc(), F.col("score").desc(),
             F.coalesce(F.col("published_at") != "", F.lit(False)).desc(), F.col("pos").asc()]
    if k is None:
        return number_rows(candidates, [key], order, [("_official", F.coalesce("official", F.lit(False)), False),
                                                      ("_score", F.coalesce("score", F.lit(float("-inf"))), False)], "candidate_rank")
    return top_k(candidates, [key], order, k, "candidate_rank")


def sort_series(rows: DataFrame, keys: Sequence[str] = ("series_id",), ts: str = "ts") -> DataFrame:
    """Range-sort by series and time, so long series span several partitions."""
    return rows.orderBy(*keys, ts)


def limit_page(rows: DataFrame, order: Sequence[Column], length: int, after: Column | None = None) -> DataFrame:
    """One page of an ordered listing: the first ``length`` rows beyond the key bound ``after``
    (a condition on the last row of the page before), so no page gathers the ones before it."""
    page = rows if after is None else rows.where(after)
    return page.orderBy(*order).limit(length)
