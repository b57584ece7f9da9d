"""Search results and pages to validated, de-duplicated evidence packets."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridledger.functions.plan import compute_once
from gridledger.functions.text import strip
from gridledger.functions.urls import canonicalize_url, host
from gridledger.operators.evidence import (
    accept_validated, dedup_capped, greedy_dedup, group_candidates, packet_rollup, page_gate, retained_rollup,
    score_discovery, score_page, validated_rollup, with_dedup_keys, with_plan_terms)
from gridledger.operators.gates import citation_release, clean_claims, validate_citations
from gridledger.operators.joins import join_authority
from gridledger.operators.ranking import cap_documents, number_sources, top_candidates
from gridledger.session import cut_lineage
from gridledger.sources.web import extract_page_text

PLAN_COLUMNS = ("question_terms", "entity_terms", "geography_terms", "intent_terms", "entities",
                "geography", "official_domains")

HELD_CITED_EXPLANATION = ("The research system retrieved and reviewed sources, but none provided enough direct, answerable"
                          " evidence to support a factual conclusion.")


@dataclass(frozen=True)
class EvidenceTables:
    candidates: DataFrame
    documents: DataFrame
    packets: DataFrame
    validated: DataFrame
    retained: DataFrame


def discover(plans: DataFrame, results: DataFrame, authorities: DataFrame, k: int | None = None) -> DataFrame:
    """Scored, grouped and ranked candidates per question, the best ``k`` where given.

    Results carry no plan text: terms are computed once per plan, and only the
    columns scoring needs travel with the join.
    """
    terms = with_plan_terms(plans).select("question_id", *PLAN_COLUMNS)
    clean = compute_once(results, {"url": canonicalize_url(F.col("url"))}).where("url <> ''")
    clean = join_authority(compute_once(clean, {"host": host(F.col("url"))}), "host", authorities)
    scored = score_discovery(clean.join(terms, "question_id")).drop(*PLAN_COLUMNS)
    return top_candidates(group_candidates(scored), k)


def collect(candidates: DataFrame, plans: DataFrame, pages: DataFrame, authorities: DataFrame,
            max_chars: int | None = None, tried: int | None = None, accepted: int | None = None) -> DataFrame:
    """Tried candidates with page text, relevance and gate outcome.

    ``pages`` is keyed by ``url`` (the canonical request URL) with ``final_url``
    and ``html``; page text is extracted once per distinct page. ``tried`` limits the
    candidates of a question that reach their pages, ``accepted`` the pages after which
    it stops; both are off by default.
    """
    terms = with_plan_terms(plans).select("question_id", *PLAN_COLUMNS)
    chosen = candidates if tried is None else candidates.where(F.col("candidate_rank") <= tried)
    chosen = chosen.select(
        "question_id", F.col("candidate_rank").alias("pos"), "url", F.col("score").alias("discovery_score"),
        F.col("title").alias("result_title"), "official")
    wanted = pages.join(chosen.select("url").distinct(), "url", "left_semi")
    texts = extract_page_text(wanted).drop("html")
    texts = join_authority(compute_once(texts, {"host": host(F.col("final_url"))}), "host", authorities)
    docs = chosen.join(texts, "url", "left").withColumn(
        "reject_reason", F.when(F.col("final_url").isNull(), "not_fetched").otherwise(F.col("reject_reason")))
    docs = score_page(docs.join(terms, "question_id"), max_chars).drop(*PLAN_COLUMNS)
    docs = page_gate(docs).withColumns({
        "title": F.coalesce(F.nullif("title", F.lit("")), F.col("result_title")),
        "source_tier": F.coalesce("tier", F.lit("supporting")),
        "provider": F.coalesce("organization", F.col("host")),
        "official": F.col("official") | F.col("tier").isNotNull()})
    return cap_documents(docs, candidates=None, documents=accepted)


def evidence_batch(plans: DataFrame, results: DataFrame, pages: DataFrame, scores: DataFrame,
                   authorities: DataFrame, k: int | None = None, tried: int | None = None,
                   accepted_pages: int | None = None) -> EvidenceTables:
    """Discovery to retained evidence. ``scores`` holds the model's verdict per
    (question_id, url): relevance_score, relevant, answerable, source_scope.

    ``k``, ``tried`` and ``accepted_pages`` limit candidates, tried pages and accepted pages of
    a question; all off by default. An accepted page without a verdict is a failed validation:
    it stays, rejected, and is counted. Every plan has a row in ``validated``.

    Candidates and tried documents are checkpointed: several outputs read them, and
    neither the scoring nor the page extraction should run once per output.
    """
    candidates = cut_lineage(discover(plans, results, authorities, k))
    documents = cut_lineage(collect(candidates, plans, pages, authorities, tried=tried, accepted=accepted_pages))
    accepted = documents.where("accepted").withColumn("request_url", F.col("url")).withColumn(
        "url", F.col("final_url")).drop("accepted")
    packets = packet_rollup(accepted)
    scored = accepted.join(scores.withColumnRenamed("url", "request_url").withColumn("_scored", F.lit(True)),
                           ["question_id", "request_url"], "left")
    failed = F.col("_scored").isNull() | F.col("relevance_score").isNull()
    scored = scored.withColumns({"validation_failed": failed, "relevance_score": F.coalesce("relevance_score", F.lit(0.0))})
    judged = accept_validated(scored.drop("_scored"))
    failures = judged.groupBy("question_id").agg(
        F.count_if("validation_failed").alias("failed_count"),
        F.count_if(~F.col("accepted") & ~F.col("validation_failed")).alias("rejected_count"))
    validated = (plans.select("question_id").distinct().join(validated_rollup(judged), "question_id", "left")
                 .join(failures, "question_id", "left"))
    counts = ("accepted_count", "direct_count", "answerable_count", "controlling_count", "domain_count", "failed_count", "rejected_count")
    validated = validated.withColumns({**{c: F.coalesce(c, F.lit(0)) for c in counts}, "sufficient": F.coalesce("sufficient", F.lit(False)),
                                       "reason": F.coalesce("reason", F.lit("no_evidence"))})
    keyed = with_dedup_keys(judged.where("accepted"))
    kept = greedy_dedup(keyed, "question_id") if accepted_pages is None else dedup_capped(keyed, cap=accepted_pages)
    return EvidenceTables(candidates, documents, packets, validated, kept)


def packet_status(tables: EvidenceTables) -> DataFrame:
    """Final sufficiency per question; de-duplication overrides the earlier verdict."""
    final = retained_rollup(tables.retained).withColumnRenamed("reason", "final_reason")
    out = tables.validated.drop("sufficient").join(final, "question_id", "left")
    return out.withColumns({
        "sufficient": F.coalesce("sufficient", F.lit(False)),
        "retained_count": F.coalesce("retained_count", F.lit(0)),
        "reason": F.coalesce("final_reason", F.when(F.col("accepted_count") > 0, "only_duplicates_or_generic")
                             .otherwise(F.col("reason")))}).drop("final_reason")


@dataclass(frozen=True)
class CitedTables:
    answers: DataFrame
    sources: DataFrame
    claims: DataFrame


def cited_answers(plans: DataFrame, tables: EvidenceTables, drafts: DataFrame, claims: DataFrame) -> CitedTables:
    """Evidence to cited or held answers, one row per plan.

    ``drafts`` holds the model's answers (question_id, direct_answer, explanation, confidence,
    limitations) and ``claims`` their claims (question_id, text, source_ids, claim_type). Retained
    documents become numbered sources in their order. A question without sufficient evidence
    or without a draft is held with its reason and the number of failed validations. The
    sources and claims of an answered question are checked together (``validate_citations``);
    they are part of that one answer, which bounds the lists.
    """
    status = packet_status(tables).select(
        "question_id", "sufficient", "reason", "retained_count", "rejected_count", "failed_count")
    draft = drafts.select("question_id", F.col("direct_answer").alias("model_answer"), F.col("explanation").alias("model_explanation"),
                          F.col("confidence").alias("model_confidence"), F.col("limitations").alias("model_notes"))
    packets = cut_lineage(plans.select("question_id", "question").join(status, "question_id").join(draft, "question_id", "left"))
    drafted = F.col("model_answer").isNotNull()
    packets = packets.withColumns({
        "reason": F.when(F.col("sufficient") & ~drafted, "no_model_answer").otherwise(F.col("reason")),
        "sufficient": F.col("sufficient") & drafted})
    open_ids = packets.where("sufficient").select("question_id", F.col("retained_count").cast("int").alias("max_source_id"))
    sources = number_sources(tables.retained.where("retained").join(open_ids.select("question_id"), "question_id", "left_semi"))
    sources = sources.select("question_id", F.col("source_no").cast("int").alias("source_id"), "title", "url", "provider", "source_tier")
    clean = clean_claims(claims.join(open_ids, "question_id")).select("question_id", "text", "source_ids", "claim_type")
    packed = packets.join(
        sources.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "url"))).alias("sources")), "question_id", "left").join(
        clean.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("text", "source_ids", "claim_type"))).alias("claims")),
        "question_id", "left")
    failed = F.when(F.col("failed_count") > 0, F.array(F.format_string("%d validations failed", F.col("failed_count")))).otherwise(
        F.array().cast("array<string>"))
    notes = F.filter(F.transform(F.coalesce("model_notes", F.array().cast("array<string>")), strip), lambda n: n != "")
    released = citation_release(packed.withColumns({
        "document_count": F.col("retained_count"), "direct_answer": F.col("model_answer"), "failures": failed, "notes": F.array_distinct(notes),
        "sources": F.coalesce("sources", F.array().cast("array<struct<source_id: int, url: string>>")),
        "claims": F.coalesce("claims", F.array().cast("array<struct<text: string, source_ids: array<int>, claim_type: string>>"))}))
    explanation = F.when(F.col("status") == "held", HELD_CITED_EXPLANATION).otherwise(strip(F.col("model_explanation")))
    checked = validate_citations(released.withColumn("explanation", explanation), every_claim_cited=False)
    answers = checked.select("question_id", "status", "direct_answer", "explanation", "confidence", "limitations",
                             F.col("retained_count").alias("accepted_documents"), F.col("rejected_count").alias("rejected_documents"),
                             F.col("failed_count").alias("validation_failures"), "errors", "passed")
    return CitedTables(answers, sources, clean)
