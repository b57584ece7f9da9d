"""Route every question to the pipeline that can answer it."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.operators.labels import route_questions, with_operating_labels
from gridledger.plans.prices import answer_prices
from gridledger.plans.reactors import answer_reactors
from gridledger.plans.series import answer_operating
from gridledger.session import cut_lineage

UNKNOWN_ANSWER = "Please provide an energy-market, fuel, asset, regulatory or grid-related question."
PLANNED_ANSWER = ("The question was classified successfully, but its live source executor has not"
                  " yet been connected.")
UNKNOWN_EXPLANATION = ("The query could not be mapped to an energy-market, fuel, asset, grid, weather or regulatory"
                       " research path.")
PLANNED_LIMITATION = "No validated live executor is currently registered for this route."
NO_RECORD = ("The market executor did not return a validated evidence record.", "Missing CAISO evidence record.")
NOT_COMPLETE = ("The official result did not contain complete interval coverage.",
                "Incomplete CAISO market-day coverage.")
ANSWER_COLUMNS = ("question_id", "pathway", "domain", "status", "confidence", "direct_answer", "simple_explanation",
                  "limitations", "planned_providers")


def assign_pathways(questions: DataFrame) -> DataFrame:
    """Add the route and a ``pathway`` label."""
    routed = route_questions(with_operating_labels(questions))
    operating = F.col("authority").isNotNull() & F.col("metric").isNotNull()
    market = F.col("domain") == "electricity_markets"
    return routed.withColumn(
        "pathway", F.when(F.col("domain") == "unknown", "clarify")
        .when(F.col("domain") == "nuclear", "reactors")
        .when(market & operating, "operating")
        .when(market & (F.col("geography") == "california"), "prices")
        .otherwise("research"))


def research_explanation(df: DataFrame) -> DataFrame:
    return df.withColumn("simple_explanation", F.concat(
        F.lit("This question was routed to the "), "domain",
        F.lit(" research pathway. The preferred evidence sequence is: "),
        F.when(F.size("providers") > 0, F.array_join("providers", ", ")).otherwise("no approved providers resolved"),
        F.lit(". A numerical or factual claim will not be published until the required source"
              " executors return validated evidence.")))


def dispatch(questions: DataFrame, price_rows: DataFrame, series: DataFrame,
             reports: DataFrame, file: str | None = None) -> DataFrame:
    """One answer row per question; each pathway only sees its own questions.

    ``reports`` are landed reactor pages (page_id, html, report_date); ``file`` names the column
    of ``price_rows`` whose files are refused as a whole.

    The routed questions are checkpointed once, because every pathway reads them.
    """
    routed = cut_lineage(assign_pathways(questions).select(
        "question_id", "question", "as_of", "domain", "pathway", "providers", "planned_providers"))

    def of(name: str) -> DataFrame:
        return routed.where(F.col("pathway") == name)

    columns = list(ANSWER_COLUMNS)
    clarify = of("clarify").withColumns({
        "status": F.lit("needs_clarification"), "confidence": F.lit("insufficient"),
        "direct_answer": F.lit(UNKNOWN_ANSWER), "simple_explanation": F.lit(UNKNOWN_EXPLANATION)})
    planned = research_explanation(of("research")).withColumns({
        "status": F.lit("research_required"), "confidence": F.lit("pending_research"),
        "direct_answer": F.lit(PLANNED_ANSWER), "limitations": F.array(F.lit(PLANNED_LIMITATION))})
    operating = answer_operating(of("operating"), series)
    operating = operating.withColumn("status", F.when(
        F.col("status") == "stale", "answered").otherwise(F.col("status")))
    prices = answer_prices(of("prices"), price_rows, file=file)
    held, missing = F.col("status") == "held", F.coalesce("coverage", F.lit("empty")) == "empty"
    note = lambda n: F.when(held, F.when(missing, NO_RECORD[n]).otherwise(NOT_COMPLETE[n]))
    prices = prices.withColumns({"simple_explanation": F.coalesce("simple_explanation", note(0)),
                                 "limitations": F.array_compact(F.array(note(1)))})
    parts = [clarify, planned, answer_reactors(of("reactors"), reports), operating, prices]

    def complete(part: DataFrame) -> DataFrame:
        if "limitations" not in part.columns:
            part = part.withColumn("limitations", F.array().cast("array<string>"))
        return part.select(*columns)
    return reduce(DataFrame.unionByName, [complete(p) for p in parts])
