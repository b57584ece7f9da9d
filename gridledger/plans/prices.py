"""Price questions end to end."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.plan import compute_once
from gridledger.functions.text import norm_text
from gridledger.functions.times import market_date_status, resolve_market_date
from gridledger.operators.labels import is_blank_question, resolve_hub, resolve_price_market
from gridledger.operators.prices import DAY_KEYS, PriceDays, asked_days, price_answer_text, with_window
from gridledger.session import cut_lineage

#: Summary rows (three short keys and ten numbers) that meet the questions by broadcast.
BROADCAST_DAYS = 100_000
CLARIFY_ANSWER = "Please specify which CAISO market price you want."


def resolve_price_questions(questions: DataFrame, as_of: str = "as_of",
                            text: str = "question", zone: str = fv.PRICE_ZONE) -> DataFrame:
    """Hub, market, date and window of each question, with one status."""
    df = compute_once(questions, {"_norm": norm_text(F.col(text))})
    df = compute_once(df, {
        "_hub": resolve_hub("_norm"), "market": resolve_price_market("_norm"),
        "market_date": resolve_market_date(F.col(text), F.col(as_of), zone, F.col("_norm"))})
    df = df.withColumns({"location": F.col("_hub.location"), "display_name": F.col("_hub.display_name")})
    status = (
        F.when(is_blank_question(F.col(text)), "empty_question")
        .when(F.col("location").isNull(), "unsupported_location")
        .when(F.col("market") == "UNSPECIFIED", "needs_clarification")
        .when(F.col("market") == "AMBIGUOUS", "ambiguous_market")
        .otherwise(market_date_status(F.col(text), F.col("market_date"), F.col("_norm"))))
    df = compute_once(df, {"status": status}).drop("_norm", "_hub")
    return with_window(df, zone)


def answer_prices(questions: DataFrame, price_rows: DataFrame | PriceDays, as_of: str = "as_of", file: str | None = None,
                  broadcast_days: int = BROADCAST_DAYS) -> DataFrame:
    """Answered, held (faulty, empty or incomplete day, refused file) or unresolved price questions.

    Landed prices (``PriceDays``) are read for the asked days alone; a table of rows is read whole.

    Questions are resolved twice: for the days they ask, which are checkpointed, and to meet one finished
    summary row each. Up to ``BROADCAST_DAYS`` asked days come by broadcast; with more, unresolved
    questions take no part in the join, as their keys would meet in one task.
    """
    resolved = resolve_price_questions(questions, as_of).drop("utc_start", "utc_end", "expected_count")
    known = resolved.where("status = 'resolved'")
    asked = cut_lineage(known.select(*DAY_KEYS).distinct())
    days = asked_days(price_rows, asked, file=file).select(
        *DAY_KEYS, "coverage", "expected_count", "actual_count", "average_price", "minimum_price",
        "maximum_price", "minimum_start", "maximum_start", "utc_end")
    if asked.count() <= broadcast_days:
        keyed = days.toDF(*(f"_{c}" if c in DAY_KEYS else c for c in days.columns))
        match = [F.col("status") == "resolved", *(F.col(k) == F.col(f"_{k}") for k in DAY_KEYS)]
        out = resolved.join(F.broadcast(keyed), match, "left").drop(*(f"_{k}" for k in DAY_KEYS))
    else:
        out = known.join(days, list(DAY_KEYS), "left").unionByName(
            resolved.where("status is distinct from 'resolved'"), allowMissingColumns=True)
    direct, explain = price_answer_text(F.col("display_name"))
    complete = F.coalesce(F.col("coverage") == "complete", F.lit(False))
    status = F.when(F.col("status") == "resolved", F.when(complete, "answered").otherwise("held")).otherwise(
        F.col("status"))
    return out.withColumns({
        "direct_answer": F.when(F.col("status") == "needs_clarification", CLARIFY_ANSWER).when(
            complete, direct).otherwise("The CAISO price answer was held."),
        "simple_explanation": F.when(complete, explain),
        "confidence": F.when(complete, "high").otherwise("insufficient"),
        "status": status})
