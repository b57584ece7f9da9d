"""Gate rules one at a time, citations, URL forms and labels."""
from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gridledger import dims
from gridledger.functions.text import answer_terms, extract_nodes, tokenize
from gridledger.functions.urls import canonicalize_url, dedup_url
from gridledger.operators.evidence import accept_validated
from gridledger.operators.gates import clean_claims, quality_gate, term_overlap, validate_citations
from gridledger.operators.joins import join_authority, join_provider, match_providers, match_sources
from gridledger.operators.labels import (
    classify_questions, parse_market_questions, plan_capabilities, plan_research)
from gridledger.plans.dispatch import assign_pathways

BASE = {"question_id": 1, "record_count": 2, "primary_count": 1, "independent_count": 2,
        "newest_at": datetime(2026, 8, 2, 8), "oldest_at": datetime(2026, 8, 2, 8), "evaluated_at": datetime(2026, 8, 2, 9),
        "has_conflict": False, "complete_coverage": True, "has_unit": True, "has_market_context": True,
        "has_timezone": True, "calculation_verified": True, "claim_type": "numeric_fact"}
SCHEMA = ("question_id int, record_count long, primary_count long, independent_count long, newest_at timestamp, oldest_at timestamp,"
          " evaluated_at timestamp, has_conflict boolean, complete_coverage boolean, has_unit boolean, has_market_context boolean,"
          " has_timezone boolean, calculation_verified boolean, claim_type string")


@pytest.mark.parametrize("change, decision, score, issues", [
    ({}, "release", 100, []),
    ({"record_count": 0, "primary_count": 0}, "refuse_numeric_claim", 0,
     ["no_evidence", "insufficient_cross_check", "no_primary_source"]),
    ({"primary_count": 0}, "release_with_warning", 65, ["no_primary_source"]),
    ({"newest_at": None}, "refuse_numeric_claim", 80, ["missing_observation_time"]),
    ({"has_conflict": True}, "hold", 65, ["source_conflict"]),
    ({"complete_coverage": False}, "release_with_warning", 80, ["incomplete_coverage"]),
    ({"has_unit": False}, "refuse_numeric_claim", 80, ["missing_unit"]),
    ({"has_timezone": False}, "release_with_warning", 85, ["missing_timezone"]),
    ({"claim_type": "calculation", "calculation_verified": False}, "refuse_numeric_claim", 65, ["unverified_calculation"]),
    ({"claim_type": "explanation", "independent_count": 1, "record_count": 1}, "release_with_warning", 55,
     ["insufficient_cross_check"]),
    ({"claim_type": "observed_fact", "has_unit": False}, "release", 100, []),
])
def test_quality_gate(spark, change, decision, score, issues):
    row = {**BASE, **change}
    df = spark.createDataFrame([tuple(row.values())], SCHEMA)
    got = quality_gate(df, dims.claim_requirements(spark)).first()
    assert (got.decision, got.score, got.issues) == (decision, score, issues)


def test_maximum_age_needs_a_custom_rule(spark):
    df = spark.createDataFrame([tuple(BASE.values())], SCHEMA)
    rules = dims.claim_requirements(spark).withColumn("max_age_seconds", F.lit(1800).cast("bigint"))
    got = quality_gate(df, rules).first()
    assert got.issues == ["stale_evidence"] and got.score == 75 and got.decision == "release_with_warning"


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


@pytest.mark.parametrize("url, canonical, identity", [
    ("HTTPS://www.EIA.gov:443//a//b/?utm_source=x&id=1&ref=y#top", "https://eia.gov/a/b?id=1", "https://eia.gov/a/b/"),
    ("http://x.org", "http://x.org/", "http://x.org/"),
    ("http://x.org:8080/a?q=a+b&e=", "http://x.org:8080/a?q=a+b&e=", "http://x.org:8080/a"),
    (" no url ", "no url", " no url "),
])
def test_url_forms(spark, url, canonical, identity):
    assert one(spark, canonicalize_url, url) == canonical
    assert one(spark, dedup_url, url) == identity


def test_terms(spark):
    assert sorted(one(spark, tokenize, "What is the PG&E load? load, CO-2")) == ["co-2", "load", "pg&e"]
    assert sorted(one(spark, answer_terms, "Day-ahead batteries, prices & class PG&E of the")) == [
        "ahead", "battery", "class", "day", "pgande", "price"]
    assert one(spark, extract_nodes, "np15, SP-15 and NP-15, TH_X_1") == ["NP-15", "SP-15", "TH_X_1"]
    share = spark.sql("select 'solar prices rise' q, 'The solar price fell' a").select(term_overlap(F.col("q"), F.col("a"))).first()[0]
    assert share == pytest.approx(2 / 3)


def test_host_lookups(spark):
    hosts = spark.createDataFrame([("eia.gov",), ("api.eia.gov",), ("notferc.gov",), ("www2.energy.ca.gov",), ("oasis.caiso.com",)], "host string")
    tiers = {r.host: r.organization for r in join_authority(hosts, "host", dims.authorities(spark)).collect()}
    assert tiers["api.eia.gov"].startswith("U.S. Energy Information") and tiers["notferc.gov"] is None
    assert tiers["www2.energy.ca.gov"] == "California Energy Commission"
    providers = {r.host: r.provider_id for r in join_provider(hosts, "host", dims.providers(spark)).collect()}
    assert providers["oasis.caiso.com"] == "caiso_oasis" and providers["www2.energy.ca.gov"] is None


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id int, question string").withColumn(
        "as_of", F.lit("2026-08-03 05:00:00").cast("timestamp"))


def test_classification_and_providers(spark):
    q = ask(spark, "What was the NP-15 day-ahead price?", "Is Diablo Canyon operating at full capacity?", "Tell me a story")
    got = match_providers(plan_capabilities(classify_questions(q))).orderBy("question_id").collect()
    assert (got[0].commodity, got[0].topic, got[0].geography) == ("electricity", "price", "california")
    assert got[0].entities == ["NP-15"] and got[0].providers[0] == "caiso_oasis"
    assert (got[1].commodity, got[1].topic) == ("nuclear", "asset_status") and "nrc_reactor_status" in got[1].providers
    assert (got[2].commodity, got[2].topic, got[2].geography) == ("unknown", "general", "unknown")
    assert "woodmac_optional" not in got[2].providers


def test_routing(spark):
    q = ask(spark, "What is ERCOT load right now?", "Why did Henry Hub gas price rise?", "latest FERC tariff filing",
            "community unity", "solar and wind curtailment in 2023", "fuel outlook", "New York real time LMP", "something new")
    got = {r.question_id: r for r in assign_pathways(q).collect()}
    assert (got[0].domain, got[0].geography, got[0].freshness, got[0].pathway) == (
        "electricity_markets", "texas", "live", "operating")
    assert (got[1].domain, got[1].mode, got[1].cross_source) == ("natural_gas", "hybrid_research", True)
    assert (got[2].domain, got[2].mode, got[2].freshness) == ("transmission_regulation", "official_document", "current")
    assert (got[3].domain, got[3].pathway) == ("unknown", "clarify")
    assert (got[4].domain, got[4].freshness) == ("renewables", "historical")
    assert got[5].domain == "general_energy" and got[5].providers == ["universal_energy_research"]
    assert got[6].geography == "new_york" and got[6].pathway == "research"
    assert got[7].freshness == "stable"  # "new " needs a following word


def test_market_questions(spark):
    q = ask(spark, "north hub price yesterday", "community filing", "NP15 LMP today", "Diablo Canyon outage")
    got = plan_research(parse_market_questions(q)).orderBy("question_id").collect()
    assert [r.market for r in got] == ["ERCOT", "GENERAL", "CAISO", "CAISO"]
    assert [r.intent for r in got] == ["price", "generation", "price", "generation"]  # "unit" is inside "community"
    assert [str(r.requested_date) for r in got] == ["2026-08-01", "None", "2026-08-02", "None"]
    assert got[2].connectors == ["caiso_oasis"] and got[2].warnings == []
    assert got[3].connectors == ["nrc_reactor_status"] and got[3].mode == "hybrid"
    sources = match_sources(parse_market_questions(q), dims.source_policy(spark)).orderBy("question_id").collect()
    assert sources[2].sources == ["caiso_oasis", "caiso", "reuters", "sp_global_public", "wood_mackenzie_public"]


def test_validated_documents(spark):
    rows = [(0.62, "Direct", True, True), (1.7, "partial", False, True), (0.9, "odd", True, True), (0.61, "direct", True, True)]
    got = accept_validated(spark.createDataFrame(rows, "relevance_score double, source_scope string, relevant boolean, answerable boolean")).collect()
    assert [(r.accepted, r.answerable) for r in got] == [(True, True), (True, False), (False, False), (False, False)]
    assert got[1].semantic_score == 1.0 and got[2].scope == "irrelevant"


def test_claims_and_citations(spark):
    claims = spark.createDataFrame([("a", [1, 9, 1], "FACT", 2), ("b", [9], "fact", 2), ("c", [], "guess", 2)],
                                   "text string, source_ids array<int>, claim_type string, max_source_id int")
    assert [(r.text, r.source_ids, r.claim_type) for r in clean_claims(claims).collect()] == [("a", [1], "fact"), ("c", [], "context")]
    answers = spark.createDataFrame(
        [("answered", "solar price", "The solar price rose", "", [("x", [1], "fact")], [(1, "u")]),
         ("answered", "solar price", "Bananas", "", [("x", [3], "fact")], [(1, "u"), (2, "u")]),
         ("answered", "solar price", "The solar price rose", "", [("x", [], "context"), ("y", [1], "fact")], [(1, "u")]),
         ("held", "q", "", "", [], [])],
        "status string, question string, direct_answer string, explanation string,"
        " claims array<struct<text:string,source_ids:array<int>,claim_type:string>>, sources array<struct<source_id:int,url:string>>")
    got = validate_citations(answers).collect()
    assert got[0].passed and got[3].passed and got[3].overlap == 0.0
    assert got[1].errors == ["unknown_source", "low_overlap", "duplicate_sources", "invalid_source_ids"]
    assert got[2].errors == ["uncited_claim"]
    facts_only = validate_citations(answers.where("status = 'answered'").withColumn("explanation", F.lit("because")), every_claim_cited=False).collect()
    assert facts_only[2].passed


def test_terms_are_found_as_by_contains(spark):
    from gridledger.functions.terms import find_terms

    terms = ("a", "ab", "abc", "bc", "lng", "lng export", "o'hara \\ x", "é", "power", "powerful grid", " day ")
    texts = ["abc", "xab", "", None, "lng exports", "lng expor", "o'hara \\ x", "cafés", "powerful gri", "powerful grid", "a day off", "zzz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.ids for r in df.select("t", find_terms(F.col("t"), terms).alias("ids")).collect()}
    assert got == {t: [i for i, term in enumerate(terms) if term in (t or "")] for t in texts}


def test_term_index_against_plain_search(monkeypatch):
    """Terms of every width, over row ends, steps, slices of arrays, nulls and letters of several bytes."""
    import random

    import pyarrow as pa

    from gridledger.functions import terms as module
    rng = random.Random(4)
    letters = "abé \u20ac"
    for round_no in range(60):
        monkeypatch.setattr(module, "STEP", rng.choice([3, 17, 1 << 22]))
        wanted = list({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 12))})
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 25))]
        found = module.TermIndex(wanted).search(pa.array(texts, pa.string())[2:]).to_pylist()
        assert found == [[n for n, t in enumerate(wanted) if t in (x or "")] for x in texts[2:]]
