"""Computed results shaped as evidence records."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.times import iso_utc
from gridledger.operators.prices import interval_name

FLAGS = ("complete_coverage", "has_unit", "has_market_context", "has_timezone",
         "calculation_verified")


def _record(df: DataFrame, keep: tuple[str, ...], provider: str, method: str, observed: Column,
            payload: dict[str, Column], flags: dict[str, Column | None]) -> DataFrame:
    return df.select(
        *keep, F.lit(provider).alias("provider_id"), F.lit(method).alias("method"),
        observed.alias("observed_at"),
        F.struct(*[c.cast("string").alias(n) for n, c in payload.items()]).alias("payload"),
        F.lit(True).alias("is_primary"), F.lit(1).alias("authority_rank"),
        F.struct(*[(F.lit(None).cast("boolean") if flags.get(n) is None else flags[n]).alias(n)
                   for n in FLAGS]).alias("flags"))


def price_records(summaries: DataFrame, keep: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Day summaries with answer text as records of the price source."""
    complete = F.coalesce(F.col("coverage") == "complete", F.lit(False))
    yes = F.lit(True)
    return _record(
        summaries, keep, "caiso_oasis", "structured_api", F.col("utc_end"),
        {"direct_answer": F.col("direct_answer"), "simple_explanation": F.col("simple_explanation"),
         "value": F.round("average_price", 6), "unit": F.lit("USD/MWh"),
         "market": F.concat(F.lit("CAISO "), "market", F.lit(" "), "display_name"),
         "timezone": F.lit(fv.PRICE_ZONE), "interval": interval_name(F.col("market"))},
        {"complete_coverage": complete, "has_unit": yes, "has_market_context": yes,
         "has_timezone": yes, "calculation_verified": yes})


def reactor_records(statuses: DataFrame, keep: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Plant statuses as records; observed at 08:00 UTC of the report date."""
    yes = F.lit(True)
    observed = F.col("report_date").cast("timestamp") + F.expr("interval 8 hours")
    return _record(
        statuses, keep, "nrc_reactor_status", "official_web", observed,
        {"direct_answer": F.col("direct_answer"), "simple_explanation": F.col("simple_explanation"),
         "value": F.lit(None), "unit": F.lit("percent of rated power"),
         "market": F.lit("U.S. NRC reactor status"), "timezone": F.lit("America/New_York"),
         "interval": F.lit("daily")},
        {"complete_coverage": yes, "has_unit": yes, "has_market_context": yes, "has_timezone": yes})


def operating_records(answers: DataFrame, keep: tuple[str, ...] = ("question_id",)) -> DataFrame:
    """Latest hourly values as records of the bulk operating-data source."""
    yes = F.lit(True)
    return _record(
        answers, keep, "eia_bulk_eba", "bulk_download", F.col("latest_ts"),
        {"direct_answer": F.col("direct_answer"), "simple_explanation": F.col("simple_explanation"),
         "value": F.col("latest_value"), "unit": F.col("unit"), "market": F.col("authority"),
         "timezone": F.lit("UTC"), "interval": F.lit("hourly")},
        {"complete_coverage": yes, "has_unit": yes, "has_market_context": yes, "has_timezone": yes})


def observed_text(records: DataFrame) -> DataFrame:
    return records.withColumn("observed_text", iso_utc(F.col("observed_at")))
