"""Retrieved records to released answers, all questions at once."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger import dims
from gridledger.operators.gates import (
    attempt_outcomes, draft_answers, quality_gate, quality_inputs, release_decision,
    validate_answers)
from gridledger.operators.joins import match_providers
from gridledger.operators.labels import classify_questions, plan_capabilities, plan_retrieval
from gridledger.operators.ranking import number_sources, until_satisfied
from gridledger.session import cut_lineage
from gridledger.sources.api_pages import fetch_status

METHOD_SLOTS = 1 << 16  # positions of a provider; room for 32,768 providers and 4 billion records of a step below


@dataclass(frozen=True)
class ResearchTables:
    answers: DataFrame
    sources: DataFrame
    attempts: DataFrame


def planned_attempts(questions: DataFrame) -> DataFrame:
    """Provider-method steps of every question in trial order.

    Needs ``credentials`` and ``licenses`` (arrays of provider ids).
    """
    planned = plan_capabilities(classify_questions(questions))
    matched = match_providers(planned, F.size("licenses") > 0)
    steps = plan_retrieval(matched).where("method is not null")
    return steps.withColumn("pos", F.col("provider_pos").cast("long") * METHOD_SLOTS + F.col("method_pos"))


def research_batch(questions: DataFrame, fetches: DataFrame, records: DataFrame,
                   min_records: int = 1, require_primary: bool = True) -> ResearchTables:
    """Classify, plan, walk landed attempts, assess, draft and release.

    ``questions``: question_id, question, claim_type, credentials, licenses,
    evaluated_at. ``fetches``: question_id, provider_id, method, status_code.
    ``records``: question_id, provider_id, method, record_no and the fields of
    ``draft_answers`` and ``quality_inputs``. The walked attempts, the records they
    yielded and the released answers feed several outputs, so they are checkpointed.
    """
    steps = planned_attempts(questions)
    ids = ["question_id", "provider_id", "method"]
    per_step = records.groupBy(*ids).agg(
        F.count("*").alias("records"), F.count_if("is_primary").alias("primary_records"))
    attempts = (steps.join(fetches, ids).join(per_step, ids, "left")
                .withColumn("fetch_status", fetch_status(F.col("status_code"))))
    ok = F.col("fetch_status") == "success"
    attempts = attempts.withColumns({
        "records": F.when(ok, F.coalesce("records", F.lit(0))).otherwise(0),
        "primary_records": F.when(ok, F.coalesce("primary_records", F.lit(0))).otherwise(0)})
    attempts = cut_lineage(until_satisfied(attempts, min_records=min_records,
                                           require_primary=require_primary))

    used = attempts.where(F.col("records") > 0).select(*ids, F.col("pos").alias("attempt_pos"))
    kept = records.join(used, ids)
    step = F.lit(1 << 32)
    kept = cut_lineage(kept.withColumn("pos", F.col("attempt_pos") * step + F.col("record_no")))
    claim_types = questions.select("question_id", "question", "claim_type", "evaluated_at")

    inputs = quality_inputs(kept, keys=questions).join(claim_types, "question_id")
    gated = quality_gate(inputs, dims.claim_requirements(questions.sparkSession))
    drafts = draft_answers(kept.drop("claim_type").join(
        claim_types.select("question_id", "claim_type"), "question_id")).drop("claim_type")
    outcome = attempt_outcomes(attempts, require_primary=require_primary).select(
        "question_id", F.col("warning").alias("retrieval_warning"))
    released = cut_lineage(release_decision(
        gated.join(drafts, "question_id", "left").join(outcome, "question_id", "left")))

    sources = number_sources(kept)
    sources = sources.select("question_id", "source_id", "source_no", "provider_id", "source_title",
                             "source_url", "is_primary", "observed_at")
    claims = released.where("claim_released").select(
        F.col("question_id").alias("answer_id"), "claim_id", "claim_type", "value", "unit",
        "market", "timezone", "is_inference")
    trail = sources.withColumnRenamed("question_id", "answer_id")
    cited = trail.join(claims.select("answer_id", "claim_id"), "answer_id").select(
        "answer_id", "claim_id", "source_id")
    packets = released.select(
        F.col("question_id").alias("answer_id"), "question", "direct_answer", "simple_explanation",
        "decision", F.size("limitations").alias("limitation_count"))
    verdicts = validate_answers(packets, claims, cited, trail).select(
        F.col("answer_id").alias("question_id"), "valid", "answer_errors", "answer_warnings",
        "claim_error_count")
    return ResearchTables(released.join(verdicts, "question_id"), sources, attempts)
