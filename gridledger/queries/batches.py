"""Whole pipelines over the conversation questions."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.operators.gates import HELD_ANSWER, REFUSED_ANSWER
from gridledger.plans.dispatch import (
    NO_RECORD, NOT_COMPLETE, PLANNED_ANSWER, PLANNED_LIMITATION, UNKNOWN_ANSWER, UNKNOWN_EXPLANATION, dispatch)
from gridledger.plans.research import planned_attempts, research_batch
from gridledger.queries.base import joined, nth, questions, register, sql_list, sql_nth
from gridledger.queries.gates import CLAIM_TYPES, GATE_SQL, REQ_SQL
from gridledger.queries.ingest import REACTOR_ANSWER_SQL, report_columns
from gridledger.queries.labels import (
    CLASSIFIED_SQL, MATCHED_SQL, PATHWAY_SQL, RETRIEVAL_SQL, ROUTED_SQL, planned_text)
from gridledger.queries.prices import DAYS_SQL, FILED_SQL, HOURLY_SQL, HUB_NAMES, filed_hourly, typed_hourly
from gridledger.queries.series import ANSWERED_SQL, LABELS_SQL, parsed

CODES = (429, 200, 503, 200, 404, 200, 401)


def research_inputs(spark, sf_dir):
    i = F.col("question_id")
    none = F.array().cast("array<string>")
    asked = questions(spark, sf_dir).select(
        i, "question", nth(CLAIM_TYPES, i).alias("claim_type"),
        F.when(F.pmod(i, F.lit(2)) == 0, F.array(F.lit("eia_api"))).otherwise(none).alias("credentials"),
        F.when(F.pmod(i, F.lit(4)) == 0, F.array(F.lit("woodmac_optional"))).otherwise(none).alias("licenses"),
        F.lit("2024-02-01").cast("timestamp").alias("evaluated_at"))
    steps = planned_attempts(asked)
    code = nth([str(c) for c in CODES], i + F.col("provider_pos") * 3 + F.col("method_pos")).cast("int")
    fetches = steps.select("question_id", "provider_id", "method", code.alias("status_code"))
    p = F.col("provider_pos")
    none_text = F.lit(None).cast("string")
    flag = F.lit(None).cast("boolean")
    records = steps.where(F.pmod(i + p, F.lit(5)) != 0).select(
        "question_id", "provider_id", "method", p, F.explode(F.sequence(F.lit(1), 1 + F.pmod(i + p, F.lit(2)).cast("int"))).alias("record_no"))
    records = records.withColumns({
        "is_primary": F.pmod(p, F.lit(3)) != 2, "independent_source_id": none_text,
        "observed_at": F.when(F.pmod(i, F.lit(9)) != 0, F.lit("2024-01-31").cast("timestamp")),
        "complete_coverage": F.pmod(i, F.lit(7)) != 0, "has_unit": F.when(F.pmod(p, F.lit(2)) == 0, F.pmod(i, F.lit(8)) != 0),
        "has_market_context": flag, "has_timezone": flag,
        "source_title": F.col("provider_id"), "source_url": F.concat(F.lit("https://"), "provider_id"),
        "direct_answer": F.when(F.pmod(i, F.lit(3)) != 0, F.concat(F.lit("from "), "provider_id")), "summary": none_text,
        "answer": none_text, "simple_explanation": F.lit("why"), "explanation": none_text, "value": F.col("record_no").cast("string"),
        "unit": F.lit("MWh"), "market": F.when(F.pmod(i, F.lit(10)) != 1, "CAISO"), "timezone": F.lit("UTC"), "interval": none_text})
    return asked, fetches, records


WALK_SQL = f"""{CLASSIFIED_SQL}, {MATCHED_SQL.format(licensed="(p.access <> 'optional_licensed' OR n.question_id % 4 = 0)")}, {RETRIEVAL_SQL},
s0 AS (SELECT *, CAST(provider_pos AS BIGINT) * 65536 + method_pos AS pos, {sql_list(CODES)}[((question_id + provider_pos * 3 + method_pos) % 7) + 1] AS code,
   CASE WHEN (question_id + provider_pos) % 5 = 0 THEN 0 ELSE 1 + (question_id + provider_pos) % 2 END AS landed FROM steps),
s1 AS (SELECT *, CASE WHEN code = 200 THEN landed ELSE 0 END AS records, provider_pos % 3 <> 2 AS primary_provider FROM s0),
s2 AS (SELECT *, coalesce(sum(records) OVER w, 0) AS r, coalesce(max(CASE WHEN primary_provider THEN records ELSE 0 END) OVER w, 0) AS p FROM s1
   WINDOW w AS (PARTITION BY question_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
walked AS (SELECT * FROM s2 WHERE NOT (r >= 2 AND p > 0)),
kept AS (SELECT w.*, g.n AS record_no FROM walked w JOIN (VALUES (1), (2)) g(n) ON g.n <= w.records)"""
RESEARCH_SQL = f"""{WALK_SQL}, {REQ_SQL},
inputs AS (SELECT q.question_id, {sql_nth(CLAIM_TYPES, 'q.question_id')} AS ct, count(k.pos) AS record_count, count(*) FILTER (WHERE k.primary_provider) AS primary_count,
   count(DISTINCT k.provider_id) AS independent_count, max(CASE WHEN k.pos IS NOT NULL AND q.question_id % 9 <> 0 THEN TIMESTAMP '2024-01-31' END) AS newest_at,
   coalesce(bool_and(CASE WHEN k.pos IS NOT NULL THEN q.question_id % 7 <> 0 END), true) AS complete_coverage,
   coalesce(bool_and(CASE WHEN k.provider_pos % 2 = 0 THEN q.question_id % 8 <> 0 END), true) AS has_unit,
   true AS has_market_context, true AS has_timezone, false AS has_conflict, true AS calculation_verified FROM questions q LEFT JOIN kept k USING (question_id) GROUP BY q.question_id),
{GATE_SQL[GATE_SQL.index('g0 AS'):].replace('FROM inputs i CROSS JOIN req r', 'FROM inputs i JOIN req r ON r.claim_type = i.ct').replace("r.claim_type = 'forecast' AND date_diff", 'false AND date_diff')},
lead AS (SELECT question_id, arg_min(provider_id, (pos, record_no)) AS provider_id FROM kept GROUP BY 1),
out AS (SELECT g.*, l.provider_id AS lead_provider, decision IN ('hold', 'refuse_numeric_claim') AS blocked FROM gate g LEFT JOIN lead l USING (question_id))"""


@register("research_batch", f"""WITH {RESEARCH_SQL}
SELECT question_id, claim_type, CAST(score AS INTEGER) AS score, decision, CASE decision WHEN 'release' THEN 'answered' WHEN 'release_with_warning' THEN 'answered_with_warning' ELSE 'held' END AS status,
  CASE WHEN blocked THEN 'insufficient' WHEN score >= 90 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS confidence, NOT blocked AND lead_provider IS NOT NULL AS claim_released,
  CASE decision WHEN 'hold' THEN '{HELD_ANSWER}' WHEN 'refuse_numeric_claim' THEN '{REFUSED_ANSWER}'
    ELSE CASE WHEN question_id % 3 <> 0 THEN 'from ' || lead_provider ELSE 'Authoritative evidence was retrieved successfully.' END END AS direct_answer,
  NOT (NOT blocked AND claim_type IN ('numeric_fact', 'calculation') AND question_id % 10 = 1) AS valid FROM out""")
def _research_batch(spark, sf_dir):
    tables = research_batch(*research_inputs(spark, sf_dir), min_records=2)
    return tables.answers.select("question_id", "claim_type", "score", "decision", "status", "confidence",
                                 "claim_released", "direct_answer", "valid")


@register("research_attempts", f"WITH {WALK_SQL} SELECT question_id, provider_id, method, pos, CAST(records AS BIGINT) AS records FROM walked")
def _research_attempts(spark, sf_dir):
    tables = research_batch(*research_inputs(spark, sf_dir), min_records=2)
    return tables.attempts.select("question_id", "provider_id", "method", "pos", "records")


@register("research_sources", f"""WITH {WALK_SQL} SELECT question_id, provider_id, 'source-' || row_number() OVER (PARTITION BY question_id ORDER BY pos, record_no) AS source_id FROM kept""")
def _research_sources(spark, sf_dir):
    tables = research_batch(*research_inputs(spark, sf_dir), min_records=2)
    return tables.sources.select("question_id", "provider_id", "source_id")


# ---- dispatch ----------------------------------------------------------------------------
def _norm(word: str) -> str:
    from gridledger.dims import norm

    return norm(word)


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


HUB_TESTS = [_any("n", sorted({_norm(w) for w in (display, *words)})) for _, display, words in fv.HUBS]
MARKET_TESTS = [(code, _any("n", terms)) for code, *_, terms in fv.PRICE_MARKETS]
TEXT_PRICES_SQL = f"""tp0 AS (SELECT question_id, n, CAST({HUB_TESTS[0]} AS INTEGER) AS h1, CAST({HUB_TESTS[1]} AS INTEGER) AS h2, CAST({HUB_TESTS[2]} AS INTEGER) AS h3,
   CAST({MARKET_TESTS[0][1]} AS INTEGER) AS m1, CAST({MARKET_TESTS[1][1]} AS INTEGER) AS m2, CAST({MARKET_TESTS[2][1]} AS INTEGER) AS m3 FROM routed),
tp AS (SELECT question_id, CASE WHEN h1 + h2 + h3 = 1 THEN {sql_list(HUB_NAMES)}[h1 + 2 * h2 + 3 * h3] END AS location,
   CASE WHEN m1 + m2 + m3 > 1 THEN 'AMBIGUOUS' WHEN m1 + m2 + m3 = 0 THEN 'UNSPECIFIED' ELSE ['DAM', 'FMM', 'RTM'][m1 + 2 * m2 + 3 * m3] END AS market,
   CASE WHEN contains(n, 'day before yesterday') THEN DATE '2024-01-01' WHEN contains(n, 'yesterday') THEN DATE '2024-01-02' WHEN contains(n, 'today') THEN DATE '2024-01-03' END AS market_date FROM tp0),
tpx AS (SELECT tp.*, s.actual_count, s.average_price, s.minimum_price, s.maximum_price, coalesce(s.actual_count = s.expected_count, false) AS complete,
   CASE WHEN location IS NULL THEN 'unsupported_location' WHEN market = 'UNSPECIFIED' THEN 'needs_clarification' WHEN market = 'AMBIGUOUS' THEN 'ambiguous_market'
        WHEN market_date IS NULL THEN 'missing_date' ELSE 'resolved' END AS s0 FROM tp LEFT JOIN summary s USING (location, market, market_date))"""
OPERATING_ANSWER_SQL = ANSWERED_SQL.removeprefix("WITH ")


@register("dispatch", f"""WITH {OPERATING_ANSWER_SQL}, {ROUTED_SQL}, {REACTOR_ANSWER_SQL}, {HOURLY_SQL}, {DAYS_SQL}, {TEXT_PRICES_SQL},
paths AS (SELECT r.question_id, r.domain, {PATHWAY_SQL} AS pathway FROM routed r JOIN op o USING (question_id))
SELECT p.question_id, pathway, domain, 'needs_clarification' AS status, 'insufficient' AS confidence, '{UNKNOWN_ANSWER}' AS direct_answer FROM paths p WHERE pathway = 'clarify'
UNION ALL SELECT p.question_id, pathway, domain, 'research_required', 'pending_research', '{PLANNED_ANSWER}' FROM paths p WHERE pathway = 'research'
UNION ALL SELECT p.question_id, pathway, domain, a.status, a.confidence, a.direct_answer FROM paths p JOIN reactor_answers a USING (question_id) WHERE pathway = 'reactors'
UNION ALL SELECT p.question_id, pathway, domain, CASE WHEN usable THEN 'answered' ELSE 'held' END, CASE WHEN NOT usable THEN 'insufficient' WHEN stale THEN 'medium' ELSE 'high' END,
  CASE WHEN NOT usable THEN 'The operating-data answer was held.'
       ELSE 'EIA reported ' || authority || ' ' || CASE metric {LABELS_SQL} END || ' of ' || format('{{:,}}', CAST(round_even(value, 0) AS BIGINT)) || ' ' || unit
         || ' for the hourly interval ending ' || strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') || '.'
         || CASE WHEN stale THEN ' The observation is older than the configured freshness threshold.' ELSE '' END END FROM paths p JOIN k USING (question_id) WHERE pathway = 'operating'
UNION ALL SELECT p.question_id, pathway, domain, CASE WHEN s0 <> 'resolved' THEN s0 WHEN complete THEN 'answered' ELSE 'held' END, CASE WHEN complete THEN 'high' ELSE 'insufficient' END,
  CASE WHEN s0 = 'needs_clarification' THEN 'Please specify which CAISO market price you want.' WHEN complete THEN
    printf('%s %s LMP averaged $%s/MWh on %s.', CASE location WHEN 'TH_NP15_GEN-APND' THEN 'NP-15' WHEN 'TH_SP15_GEN-APND' THEN 'SP-15' ELSE 'ZP-26' END, market,
      CAST(round(CAST(average_price AS DECIMAL(18,6)), 2) AS VARCHAR), strftime(market_date, '%Y-%m-%d')) ELSE 'The CAISO price answer was held.' END
  FROM paths p JOIN tpx USING (question_id) WHERE pathway = 'prices'""")
def _dispatch(spark, sf_dir):
    return dispatch(questions(spark, sf_dir), typed_hourly(spark, sf_dir), parsed(spark, sf_dir),
                    report_columns(spark, sf_dir)).select(
        "question_id", "pathway", "domain", "status", "confidence", "direct_answer")


@register("dispatch_notes", f"""WITH {OPERATING_ANSWER_SQL}, {ROUTED_SQL}, {FILED_SQL}, {DAYS_SQL}, {TEXT_PRICES_SQL.replace("s.actual_count = s.expected_count", "s.actual_count = s.expected_count AND NOT s.refused")},
paths AS (SELECT r.question_id, r.domain, {PATHWAY_SQL} AS pathway, coalesce(providers, '') AS providers, coalesce(planned, '') AS planned
  FROM routed r JOIN op o USING (question_id) LEFT JOIN plans USING (domain))
SELECT question_id, planned, '{UNKNOWN_EXPLANATION}' AS simple_explanation, '' AS limitations FROM paths WHERE pathway = 'clarify'
UNION ALL SELECT question_id, planned, 'This question was routed to the ' || domain || ' research pathway. The preferred evidence sequence is: '
  || CASE providers WHEN '' THEN 'no approved providers resolved' ELSE replace(providers, '|', ', ') END
  || '. A numerical or factual claim will not be published until the required source executors return validated evidence.', '{PLANNED_LIMITATION}' FROM paths WHERE pathway = 'research'
UNION ALL SELECT question_id, planned, CASE WHEN s0 = 'resolved' AND complete THEN printf('The official CAISO result contained %d validated intervals. The minimum was $%s/MWh and the maximum was $%s/MWh.',
       actual_count, CAST(CAST(minimum_price AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(maximum_price AS DECIMAL(18,2)) AS VARCHAR))
     WHEN s0 = 'resolved' AND actual_count IS NULL THEN '{NO_RECORD[0]}' WHEN s0 = 'resolved' THEN '{NOT_COMPLETE[0]}' END,
  CASE WHEN s0 <> 'resolved' OR complete THEN '' WHEN actual_count IS NULL THEN '{NO_RECORD[1]}' ELSE '{NOT_COMPLETE[1]}' END
  FROM paths p JOIN tpx USING (question_id) WHERE pathway = 'prices'""")
def _dispatch_notes(spark, sf_dir):
    out = dispatch(questions(spark, sf_dir), filed_hourly(spark, sf_dir), parsed(spark, sf_dir), report_columns(spark, sf_dir), "file")
    return out.where("pathway in ('clarify', 'research', 'prices')").select(
        "question_id", planned_text(F.col("planned_providers")).alias("planned"), "simple_explanation",
        joined(F.col("limitations")).alias("limitations"))
