"""Hourly series: latest observation, staleness and answer text."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.numbers import round_half_up
from gridledger.functions.plan import compute_once
from gridledger.functions.text import strip
from gridledger.functions.times import iso_utc, parse_period
from gridledger.operators.ranking import top_k
from gridledger.sources.series import read_item, valid_series


def series_stats(observations: DataFrame, keys: tuple[str, ...] = ("series_id",)) -> DataFrame:
    """Observation count and latest observation per series (after ``keep_last``)."""
    return observations.groupBy(*keys).agg(
        F.count("*").alias("observation_count"), F.max("ts").alias("latest_ts"),
        F.max_by("value", "ts").alias("latest_value"))


def latest_observations(series: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row per series id: first record of the id, its unit and latest value.

    ``wanted`` (a table of series ids) prunes records before their arrays are
    opened. A record that fails a rule keeps its reason instead of a value. A
    series arrives as one record, so its array is reduced in place: the greatest
    (timestamp, position) is the latest observation with the last element winning.
    The first record of an id is a rank filter, which map tasks apply before the shuffle:
    of the many records of one id, one leaves each task.
    """
    named = series.where(F.col("reject_reason").isNull() | (F.col("reject_reason") == "no_data_array"))
    named = named.withColumn("series_id", strip(F.col("series_id")))
    if wanted is not None:
        named = named.join(wanted.select("series_id").distinct(), "series_id", "left_semi")
    first = valid_series(top_k(named, ["series_id"], [F.col("file"), F.col("block"), F.col("row")], 1))
    usable = F.when(F.col("reject_reason").isNull(), F.col("data"))
    first = compute_once(first, {"_read": F.filter(
        F.transform(usable, read_item), lambda o: o["period"].isNotNull() & o["value"].isNotNull())})
    first = compute_once(first, {"_obs": F.transform("_read", lambda o, i: F.struct(
        parse_period(o["period"]).alias("ts"), i.alias("pos"), o["value"].alias("value")))})
    count = F.size(F.array_distinct(F.transform("_obs", lambda o: o["ts"])))
    faulty = F.exists("_obs", lambda o: o["ts"].isNull())
    reason = F.coalesce("reject_reason", F.when(faulty, "unsupported_period"),
                        F.when(F.size("_obs") == 0, "no_observations"))
    out = compute_once(first, {"source_reject": reason, "_last": F.array_max("_obs")})
    sound = F.col("source_reject").isNull()
    return out.select(
        "series_id", "name", "unit", "last_updated", "description", "file", "source_reject",
        F.when(sound, count).otherwise(0).alias("observation_count"),
        F.when(sound, F.col("_last.ts")).alias("latest_ts"),
        F.when(sound, F.col("_last.value")).alias("latest_value"))


def operating_answer_text(authority: Column, label: Column, value: Column, unit: Column, ts: Column,
                          series: Column, age: Column, stale: Column) -> tuple[Column, Column]:
    """Answer sentence and explanation for the latest hourly value."""
    direct = F.concat(
        F.lit("EIA reported "), authority, F.lit(" "), label, F.lit(" of "), F.format_number(value, 0),
        F.lit(" "), unit, F.lit(" for the hourly interval ending "), iso_utc(ts), F.lit("."),
        F.when(stale, " The observation is older than the configured freshness threshold.").otherwise(""))
    explain = F.concat(
        F.lit("The value comes from EIA Form EIA-930 series "), series,
        F.lit(". The observation was approximately "), F.format_string("%.1f", round_half_up(age, 6)),
        F.lit(" hours old when retrieved."))
    return direct, explain
