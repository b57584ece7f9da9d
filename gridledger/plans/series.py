"""Operating-data questions end to end."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.text import equivalent_mw
from gridledger.functions.times import age_hours, is_stale
from gridledger.operators.joins import join_latest_series
from gridledger.operators.labels import metric_label, resolve_operating_questions
from gridledger.operators.series import latest_observations, operating_answer_text


def answer_operating(questions: DataFrame, series: DataFrame, as_of: str = "as_of",
                     max_age_hours: float = fv.STALE_AFTER_HOURS) -> DataFrame:
    """Latest value per question: answered, stale, held or needs clarification.

    ``series`` holds parsed JSON-lines records. Each wanted series is parsed once
    and questions join its single latest row.
    """
    asked = resolve_operating_questions(questions)
    latest = latest_observations(series, asked.where("series_id is not null"))
    out = join_latest_series(asked, latest)
    age = age_hours(F.col("latest_ts"), F.col(as_of))
    stale = is_stale(F.col("latest_ts"), F.col(as_of), max_age_hours)
    out = out.withColumns({"age_hours": age, "stale": F.coalesce(stale, F.lit(False)),
                           "equivalent_mw": equivalent_mw(F.col("latest_value"), F.col("unit"))})
    usable = (F.col("latest_value").isNotNull() & F.col("unit").isNotNull()
              & F.col("latest_ts").isNotNull() & F.col("source_reject").isNull()
              & (F.coalesce(F.col("file"), F.lit("")) != ""))
    direct, explain = operating_answer_text(
        F.col("authority"), metric_label(F.col("metric")), F.col("latest_value"), F.col("unit"),
        F.col("latest_ts"), F.col("series_id"), F.col("age_hours"), F.col("stale"))
    clarify = F.col("status") == "needs_clarification"
    return out.withColumns({
        "direct_answer": F.when(clarify, F.concat(
            F.lit("Please specify the "), F.array_join("missing", " and "), F.lit(".")))
            .when(usable, direct).otherwise("The operating-data answer was held."),
        "simple_explanation": F.when(usable, explain),
        "confidence": F.when(clarify | ~usable, "insufficient").when(
            F.col("stale"), "medium").otherwise("high"),
        "status": F.when(clarify, F.col("status")).when(~usable, "held").when(
            F.col("stale"), "stale").otherwise("answered")})
