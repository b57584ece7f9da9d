"""Quality gate, claim and citation checks, release decisions."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.numbers import round_half_up
from gridledger.functions.text import answer_terms, blank, strip
from gridledger.operators.joins import missing_sources
from gridledger.operators.ranking import top_k

# ---- fixed values: issue warnings and rationales -----------------------------
WARNINGS = (
    ("no_primary_source", "No controlling primary source was available."),
    ("stale_evidence",
     "The newest available observation is older than the permitted freshness threshold."),
    ("incomplete_coverage",
     "The retrieved dataset does not cover every required interval or record."),
    ("source_conflict", "Material sources disagree and the conflict has not been resolved."),
    ("missing_unit", "The numerical value does not have a verified unit."),
    ("missing_timezone", "The applicable timezone was not verified."),
    ("insufficient_cross_check",
     "The claim does not have the required independent source confirmation."),
)
RATIONALES = (
    ("release", "Evidence meets all configured release requirements."),
    ("release_with_warning",
     "The evidence is usable, but the answer must disclose the identified limitations."),
    ("refuse_numeric_claim",
     "The exact numerical claim cannot be released because one or more mandatory numerical"
     " controls are missing."),
    ("hold", "The evidence is not strong enough to publish the claim as confirmed."),
)
NUMERIC_BLOCKERS = ("no_evidence missing_unit missing_market_context missing_observation_time"
                    " unverified_calculation").split()
REFUSED_ANSWER = "The exact numerical answer cannot be verified from the available evidence."
REFUSED_EXPLANATION = (
    "A value was retrieved, but one or more mandatory controls, such as unit, market, timestamp,"
    " timezone or calculation verification, were missing.")
HELD_ANSWER = "The requested answer cannot currently be confirmed."
HELD_EXPLANATION = "The available evidence did not satisfy the configured release requirements."
EMPTY_ANSWER = "The requested information could not be verified from accessible authoritative sources."
EMPTY_EXPLANATION = (
    "The research process did not obtain enough usable evidence to confirm the answer.")
DEFAULT_ANSWER = "Authoritative evidence was retrieved successfully."
DEFAULT_EXPLANATION = (
    "The answer is based on the highest-ranked accessible evidence returned by the research"
    " pipeline.")
CITED_HELD_ANSWER = "The available verified evidence is not sufficient to provide a reliable answer."
FLAG_COLUMNS = ("complete_coverage", "has_unit", "has_market_context", "has_timezone")


def _listed(column: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in pairs:
        out = F.when(column == key, value).otherwise(out)
    return out


def quality_inputs(records: DataFrame, overrides: DataFrame | None = None,
                   keys: DataFrame | None = None, key: str = "question_id") -> DataFrame:
    """Record, primary and independent-source counts, time range and flags.

    A flag is the explicit override, else "all records that carry it are true",
    else true. ``keys`` lists groups that must appear even without records.
    """
    source = F.coalesce(F.nullif("independent_source_id", F.lit("")), F.col("provider_id"))
    out = records.groupBy(key).agg(
        F.count("*").alias("record_count"),
        F.count_if("is_primary").alias("primary_count"),
        F.count_distinct(source).alias("independent_count"),
        F.max("observed_at").alias("newest_at"), F.min("observed_at").alias("oldest_at"),
        *[F.bool_and(c).alias(c) for c in FLAG_COLUMNS])
    if keys is not None:
        out = keys.select(key).distinct().join(out, key, "left").fillna(
            0, ["record_count", "primary_count", "independent_count"])
    given = [c for c in (*FLAG_COLUMNS, "calculation_verified", "has_conflict")
             if overrides is not None and c in overrides.columns]
    if given:
        out = out.join(overrides.select(key, *[F.col(c).alias(f"_{c}") for c in given]), key, "left")
    def flag(name: str, default: bool) -> Column:
        choices = [F.col(f"_{name}")] if name in given else []
        choices += [F.col(name)] if name in FLAG_COLUMNS else []
        return F.coalesce(*choices, F.lit(default))
    out = out.withColumns({**{c: flag(c, True) for c in FLAG_COLUMNS},
                           "calculation_verified": flag("calculation_verified", True),
                           "has_conflict": flag("has_conflict", False)})
    return out.drop(*[f"_{c}" for c in given])


def quality_gate(inputs: DataFrame, requirements: DataFrame) -> DataFrame:
    """Score from 100, issues, decision, warnings and rationale per input row.

    Needs ``claim_type`` and ``evaluated_at`` beside the ``quality_inputs`` columns.
    """
    df = inputs.join(requirements, "claim_type")
    c = F.col
    age = F.greatest(F.lit(0.0), c("evaluated_at").cast("double") - c("newest_at").cast("double"))
    few = c("record_count") < c("min_records")
    single = c("needs_cross_check") & (c("independent_count") < 2)
    # ---- fixed values: deduction per check, in issue order
    checks = (
        (c("record_count") == 0, "no_evidence", 100),
        (few, "insufficient_cross_check", 25),
        (c("needs_primary") & (c("primary_count") == 0), "no_primary_source", 35),
        (single, "insufficient_cross_check", 20),
        (c("needs_time") & c("newest_at").isNull(), "missing_observation_time", 20),
        (c("max_age_seconds").isNotNull() & (age > c("max_age_seconds")), "stale_evidence", 25),
        (c("has_conflict"), "source_conflict", 35),
        (~c("complete_coverage"), "incomplete_coverage", 20),
        (c("needs_unit") & ~c("has_unit"), "missing_unit", 20),
        (c("needs_market") & ~c("has_market_context"), "missing_market_context", 20),
        (c("needs_zone") & ~c("has_timezone"), "missing_timezone", 15),
        ((c("claim_type") == "calculation") & ~c("calculation_verified"), "unverified_calculation", 35),
    )
    score = F.lit(100)
    for hit, _, cost in checks:
        score = score - F.when(hit, cost).otherwise(0)
    issues = F.array_distinct(F.array_compact(F.array(*[F.when(h, F.lit(n)) for h, n, _ in checks])))
    df = df.withColumns({"score": F.greatest(F.lit(0), F.least(F.lit(100), score)), "issues": issues})
    has = lambda names: F.arrays_overlap("issues", F.array(*[F.lit(n) for n in names]))
    decision = (
        F.when(c("claim_type").isin("numeric_fact", "calculation") & has(NUMERIC_BLOCKERS),
               "refuse_numeric_claim")
        .when(has(("no_evidence", "source_conflict")), "hold")
        .when((c("score") >= 85) & (F.size("issues") == 0), "release")
        .when(c("score") >= 55, "release_with_warning").otherwise("hold"))
    warnings = F.array_compact(F.transform("issues", lambda i: _listed(i, WARNINGS)))
    df = df.withColumns({"decision": decision, "warnings": warnings})
    return df.withColumn("rationale", _listed(c("decision"), RATIONALES)).drop(
        *[n for n in requirements.columns if n != "claim_type"])


def confidence_from_quality(decision: Column, score: Column) -> Column:
    return (F.when(decision.isin("hold", "refuse_numeric_claim"), "insufficient")
            .when(score >= 90, "high").when(score >= 70, "medium").otherwise("low"))


def confidence_from_evidence(items: Column, primary: Column, conflict: Column,
                             incomplete: Column) -> Column:
    return (F.when((items == 0) | conflict | incomplete | (primary == 0), "low")
            .when(items >= 2, "high").otherwise("medium"))


def attempt_outcomes(attempts: DataFrame, key: str = "question_id",
                     require_primary: bool = True) -> DataFrame:
    """Attempts, records and closing warning per question."""
    out = attempts.groupBy(key).agg(
        F.count("*").alias("attempt_count"),
        F.count_if(F.col("fetch_status") == "success").alias("success_count"),
        F.coalesce(F.sum("records"), F.lit(0)).alias("record_count"),
        F.coalesce(F.sum("primary_records"), F.lit(0)).alias("primary_count"))
    return out.withColumns({
        "succeeded": F.col("record_count") > 0,
        "warning": F.when(F.col("record_count") == 0,
                          "No accessible provider returned usable evidence.")
                    .when(F.lit(require_primary) & (F.col("primary_count") == 0),
                          "No primary-source record was available.")})


def page_coverage(pages: DataFrame, key: str = "request_id", *, max_rows: int) -> DataFrame:
    """Rows received against the announced total, per paged request."""
    out = pages.groupBy(key).agg(
        F.count("*").alias("page_count"), F.sum("row_count").alias("rows_received"),
        F.max(F.col("offset") + F.col("row_count")).alias("reached"), F.max("total").alias("total"))
    return out.withColumn("coverage", F.when(F.col("rows_received") > max_rows, "over_row_limit")
                          .when(F.col("reached") >= F.col("total"), "complete").otherwise("partial"))


def term_overlap(question: Column, answer: Column) -> Column:
    """Share of question terms that the answer repeats."""
    asked = answer_terms(question)
    return F.size(F.array_intersect(asked, answer_terms(answer))) / F.greatest(F.size(asked), F.lit(1))


def ids_subset(cited: Column, available: Column) -> Column:
    """ok, nothing_cited or unknown_ids."""
    return (F.when(F.size(cited) == 0, "nothing_cited")
            .when(F.size(F.array_except(cited, available)) > 0, "unknown_ids").otherwise("ok"))


def urls_unique(urls: Column) -> Column:
    return F.size(F.array_distinct(urls)) == F.size(urls)


def claim_errors(claims: DataFrame, claim_sources: DataFrame, sources: DataFrame,
                 key: str = "answer_id") -> DataFrame:
    """One row per broken rule of a claim."""
    ids = [key, "claim_id"]
    cited = claim_sources.groupBy(*ids).agg(F.count("*").alias("cited_count"))
    unknown = missing_sources(claim_sources, sources, key).groupBy(*ids).agg(
        F.count("*").alias("unknown_count"))
    df = claims.join(cited, ids, "left").join(unknown, ids, "left")
    numeric = F.col("claim_type").isin("numeric_fact", "calculation") & F.col("value").isNotNull()
    rules = F.array_compact(F.array(
        F.when(F.col("unknown_count") > 0, "unknown_sources"),
        F.when(numeric & (F.coalesce("unit", F.lit("")) == ""), "missing_unit"),
        F.when(numeric & (F.coalesce("market", F.lit("")) == ""), "missing_market"),
        F.when(numeric & (F.coalesce("timezone", F.lit("")) == ""), "missing_timezone"),
        F.when(F.col("is_inference") & F.col("cited_count").isNull(), "unsupported_inference")))
    return df.select(*ids, F.explode(rules).alias("error"))


def validate_answers(answers: DataFrame, claims: DataFrame, claim_sources: DataFrame,
                     sources: DataFrame, key: str = "answer_id") -> DataFrame:
    """Error and warning counts and the verdict of every answer."""
    broken = claim_errors(claims, claim_sources, sources, key).groupBy(key).agg(
        F.count("*").alias("claim_error_count"))
    trail = sources.groupBy(key).agg(F.count("*").alias("source_count"),
                                     F.count_if("is_primary").alias("primary_count"))
    df = answers.join(broken, key, "left").join(trail, key, "left").fillna(
        0, ["claim_error_count", "source_count", "primary_count"])
    blocked = F.col("decision").isin("hold", "refuse_numeric_claim")
    errors = F.array_compact(F.array(
        F.when(blank(F.col("question")), "empty_question"),
        F.when(blank(F.col("direct_answer")), "empty_answer"),
        F.when(blank(F.col("simple_explanation")), "empty_explanation"),
        F.when(blocked & (F.col("limitation_count") == 0), "unexplained_block")))
    warnings = F.array_compact(F.array(
        F.when(F.col("primary_count") == 0, "no_primary_source"),
        F.when(F.col("source_count") < 2, "fewer_than_two_sources")))
    df = df.withColumns({"answer_errors": errors, "answer_warnings": warnings})
    return df.withColumn("valid", (F.size("answer_errors") == 0) & (F.col("claim_error_count") == 0))


def clean_claims(claims: DataFrame) -> DataFrame:
    """Usable source ids only, known claim types, no fact without a source.

    Needs ``source_ids array<int>``, ``claim_type``, ``text``, ``max_source_id``.
    """
    ids = F.array_distinct(F.filter("source_ids", lambda i: i.between(1, F.col("max_source_id"))))
    kind = F.lower(strip(F.col("claim_type")))
    kind = F.when(kind.isin("fact", "inference", "context"), kind).otherwise("context")
    out = claims.withColumns({"source_ids": ids, "claim_type": kind, "text": strip(F.col("text"))})
    return out.where((F.col("claim_type") != "fact") | (F.size("source_ids") > 0))


def validate_citations(answers: DataFrame, every_claim_cited: bool = True,
                       min_overlap: float = 0.35) -> DataFrame:
    """Check packed answers (``claims`` and ``sources`` arrays of one row).

    ``every_claim_cited`` applies the id rule to all claims, otherwise to facts
    only (and then an explanation is required). Structural rules stop at the
    first broken one; overlap, duplicate and id checks are always added.
    """
    ids = F.transform("sources", lambda s: s["source_id"])
    cited = F.array_distinct(F.flatten(F.transform("claims", lambda k: k["source_ids"])))
    first_claim_fault = F.get(F.filter(F.transform("claims", lambda k: F.when(
        blank(k["text"]), "blank_claim").when(
            (F.size(k["source_ids"]) == 0) & (F.lit(every_claim_cited) | (k["claim_type"] == "fact")),
            "uncited_claim").when(F.size(F.array_except(k["source_ids"], ids)) > 0, "unknown_source")),
        lambda e: e.isNotNull()), F.lit(0))
    structure = (
        F.when(~F.col("status").isin("answered", "held"), "invalid_status")
        .when(F.lit(not every_claim_cited) & blank(F.col("question")), "missing_question")
        .when(F.col("status") == "held", F.lit(None).cast("string"))
        .when(blank(F.col("direct_answer")), "missing_answer")
        .when(F.lit(not every_claim_cited) & blank(F.col("explanation")), "missing_explanation")
        .when(F.size("claims") == 0, "no_claims").when(F.size("sources") == 0, "no_sources")
        .otherwise(first_claim_fault))
    overlap = term_overlap(F.col("question"), F.concat_ws(" ", "direct_answer", "explanation"))
    held = F.col("status") == "held"
    answers = answers.withColumns({"_cited": cited, "_ids": ids, "_overlap": overlap})
    errors = F.array_compact(F.array(
        structure,
        F.when(~held & (F.col("_overlap") < min_overlap), "low_overlap"),
        F.when(~held & ~urls_unique(F.transform("sources", lambda s: s["url"])), "duplicate_sources"),
        F.when(~held & (F.size("_cited") == 0), "nothing_cited"),
        F.when(~held & (F.size(F.array_except("_cited", "_ids")) > 0), "invalid_source_ids")))
    out = answers.withColumns({
        "errors": errors, "overlap": F.when(held, 0.0).otherwise(round_half_up(F.col("_overlap")))})
    return out.withColumn("passed", F.size("errors") == 0).drop("_cited", "_ids", "_overlap")


def draft_answers(records: DataFrame, key: str = "question_id", pos: str = "pos") -> DataFrame:
    """Answer draft from each question's first record.

    Needs text columns ``direct_answer, summary, answer, simple_explanation,
    explanation, value, unit, market, timezone, interval`` and ``claim_type``.
    The claim cites every record; ids are ``source-1..source-n``, so ``source_count``
    states them without collecting a list.
    """
    first = top_k(records, [key], [F.col(pos).asc()], 1)
    count = records.groupBy(key).agg(F.count("*").alias("source_count"))
    text = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])
    out = first.join(count, key)
    return out.select(
        key, "claim_type", "source_count", "value", "unit", "market", "timezone", "interval",
        F.coalesce(text("direct_answer", "summary", "answer"), F.lit(DEFAULT_ANSWER)).alias("direct_answer"),
        F.coalesce(text("simple_explanation", "explanation"),
                   F.lit(DEFAULT_EXPLANATION)).alias("simple_explanation"),
        F.lit("claim-1").alias("claim_id"),
        F.col("claim_type").isin("analyst_inference", "explanation", "forecast").alias("is_inference"))


def release_decision(drafts: DataFrame) -> DataFrame:
    """Replace blocked answers by controlled text and set the status.

    Needs a draft (null text when there was no record) joined with its quality
    assessment. ``limitations`` holds warnings first, then draft and retrieval
    notes, then the rationale of a blocked answer.
    """
    decision = F.col("decision")
    blocked = decision.isin("hold", "refuse_numeric_claim")
    direct = F.when(decision == "refuse_numeric_claim", REFUSED_ANSWER).when(
        decision == "hold", HELD_ANSWER).otherwise(F.coalesce("direct_answer", F.lit(EMPTY_ANSWER)))
    explain = F.when(decision == "refuse_numeric_claim", REFUSED_EXPLANATION).when(
        decision == "hold", HELD_EXPLANATION).otherwise(
            F.coalesce("simple_explanation", F.lit(EMPTY_EXPLANATION)))
    notes = F.concat(
        F.col("warnings"),
        F.when(F.col("direct_answer").isNull(), F.array(F.lit("No usable evidence record was retrieved.")))
        .otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array("retrieval_warning", F.when(blocked, F.col("rationale")))))
    return drafts.withColumns({
        "claim_released": ~blocked & F.col("direct_answer").isNotNull(),
        "confidence": confidence_from_quality(decision, F.col("score")),
        "limitations": F.array_distinct(notes),
        "status": F.when(decision == "release", "answered").when(
            decision == "release_with_warning", "answered_with_warning").otherwise("held"),
    }).withColumns({"direct_answer": direct, "simple_explanation": explain})


def citation_release(packets: DataFrame) -> DataFrame:
    """Cited answers: an insufficient or empty packet is held with its reason."""
    held = ~F.col("sufficient") | (F.col("document_count") == 0)
    return packets.withColumns({
        "status": F.when(held, "held").otherwise("answered"),
        "confidence": F.when(held, "insufficient").otherwise(F.when(
            F.lower(strip(F.col("model_confidence"))).isin("high", "medium", "low", "insufficient"),
            F.lower(strip(F.col("model_confidence")))).otherwise("low")),
        "direct_answer": F.when(held, CITED_HELD_ANSWER).otherwise(strip(F.col("direct_answer"))),
        "limitations": F.when(held, F.array_distinct(F.concat(F.array("reason"), "failures"))).otherwise(
            F.col("notes"))})
