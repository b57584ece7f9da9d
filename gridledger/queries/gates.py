"""Quality gate, claims, citations and release on documents, labels and conversations."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridledger import dims
from gridledger.operators.gates import (
    HELD_ANSWER, RATIONALES, REFUSED_ANSWER, WARNINGS, attempt_outcomes, claim_errors,
    clean_claims, confidence_from_evidence, draft_answers, ids_subset, page_coverage, quality_gate,
    quality_inputs, release_decision, term_overlap, urls_unique, validate_answers,
    validate_citations)
from gridledger.operators.joins import missing_sources
from gridledger.operators.ranking import number_sources, until_satisfied
from gridledger.queries.base import joined, nth, register, sql_nth, sql_rows, table, utc_text
from gridledger.queries.text import answer_terms_sql

CLAIM_TYPES = ("observed_fact", "numeric_fact", "calculation", "explanation", "analyst_inference", "forecast")


# ---- evidence records: one per document, grouped by source and language -----------------
def _flag(i, n, k, absent):
    """True except every n-th row; missing on every absent-th row."""
    return F.when(F.pmod(i, F.lit(absent)) == 0, F.lit(None).cast("boolean")).otherwise(F.pmod(i, F.lit(n)) != k)


def records(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    day = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.pmod(i, F.lit(40)).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        i.alias("pos"), F.concat_ws("-", "source", "lang").alias("question_id"), F.col("source").alias("provider_id"),
        F.when(F.pmod(i, F.lit(3)) == 0, F.concat(F.lit("ind-"), F.pmod(i, F.lit(5)).cast("string"))).alias("independent_source_id"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_primary"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("conflict"),
        F.when(F.pmod(i, F.lit(4)) != 0, day).alias("observed_at"),
        _flag(i, 97, 3, 2).alias("complete_coverage"), _flag(i, 61, 5, 3).alias("has_unit"),
        _flag(i, 53, 7, 2).alias("has_market_context"), F.lit(None).cast("boolean").alias("has_timezone"))


def _flag_sql(n, k, absent):
    return f"CASE WHEN doc_id % {absent} = 0 THEN NULL ELSE doc_id % {n} <> {k} END"


INPUTS_SQL = f"""rec AS (SELECT doc_id, doc_id AS pos, source || '-' || lang AS question_id, source AS provider_id,
   coalesce(CASE WHEN doc_id % 3 = 0 THEN 'ind-' || (doc_id % 5) END, source) AS who, coalesce(quality = 1, false) AS is_primary, coalesce(toxic = 1, false) AS conflict,
   CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 40 AS INTEGER)) END AS observed_at,
   {_flag_sql(97, 3, 2)} AS cc, {_flag_sql(61, 5, 3)} AS hu, {_flag_sql(53, 7, 2)} AS hm FROM documents LEFT JOIN labels USING (doc_id)),
inputs AS (SELECT question_id, count(*) AS record_count, count(*) FILTER (WHERE is_primary) AS primary_count, count(DISTINCT who) AS independent_count,
   max(observed_at) AS newest_at, min(observed_at) AS oldest_at, coalesce(bool_and(cc), true) AS complete_coverage, coalesce(bool_and(hu), true) AS has_unit,
   coalesce(bool_and(hm), true) AS has_market_context, length(question_id) % 3 <> 0 AS has_timezone, bool_or(conflict) AND count(*) % 2 = 0 AS has_conflict,
   count(*) % 5 <> 0 AS calculation_verified FROM rec GROUP BY 1)"""


def inputs(spark, sf_dir):
    rec = records(spark, sf_dir)
    overrides = rec.groupBy("question_id").agg(
        F.bool_or("conflict").alias("any_conflict"), F.count("*").alias("n")).select(
        "question_id", (F.col("any_conflict") & (F.col("n") % 2 == 0)).alias("has_conflict"),
        (F.length("question_id") % 3 != 0).alias("has_timezone"), (F.col("n") % 5 != 0).alias("calculation_verified"))
    return quality_inputs(rec, overrides)


@register("quality_inputs", f"""WITH {INPUTS_SQL} SELECT question_id, record_count, primary_count, independent_count, strftime(newest_at, '%Y-%m-%d %H:%M:%S') AS newest_text,
  strftime(oldest_at, '%Y-%m-%d %H:%M:%S') AS oldest_text, complete_coverage, has_unit, has_market_context, has_timezone, has_conflict, calculation_verified FROM inputs""")
def _quality_inputs(spark, sf_dir):
    out = inputs(spark, sf_dir)
    return out.select("question_id", "record_count", "primary_count", "independent_count",
                      utc_text(F.col("newest_at")).alias("newest_text"), utc_text(F.col("oldest_at")).alias("oldest_text"),
                      "complete_coverage", "has_unit", "has_market_context", "has_timezone", "has_conflict",
                      "calculation_verified")


# ---- the gate on every group and claim type ------------------------------------------------
def assessed(spark, sf_dir):
    """Every record group under every claim type; a custom rule adds a maximum age."""
    out = inputs(spark, sf_dir).withColumn("claim_type", F.explode(F.array(*[F.lit(c) for c in CLAIM_TYPES])))
    out = out.withColumn("evaluated_at", F.lit("2024-02-12 00:00:00").cast("timestamp"))
    rules = dims.claim_requirements(spark).withColumn("max_age_seconds", F.when(
        F.col("claim_type") == "forecast", F.lit(3 * 86400).cast("bigint")).otherwise(F.col("max_age_seconds")))
    return quality_gate(out, rules)


REQ_SQL = "req(claim_type, np, nx, nt, nu, nm, nz, min_records) AS (VALUES " + sql_rows(
    [r[:7] + (r[8],) for r in dims.CLAIM_REQUIREMENTS]) + ")"
GATE_SQL = f"""{INPUTS_SQL}, {REQ_SQL},
g0 AS (SELECT i.*, r.*, list_filter([CASE WHEN record_count = 0 THEN {{'i': 'no_evidence', 'c': 100}} END,
   CASE WHEN record_count < min_records THEN {{'i': 'insufficient_cross_check', 'c': 25}} END,
   CASE WHEN np AND primary_count = 0 THEN {{'i': 'no_primary_source', 'c': 35}} END,
   CASE WHEN nx AND independent_count < 2 THEN {{'i': 'insufficient_cross_check', 'c': 20}} END,
   CASE WHEN nt AND newest_at IS NULL THEN {{'i': 'missing_observation_time', 'c': 20}} END,
   CASE WHEN r.claim_type = 'forecast' AND date_diff('second', newest_at, TIMESTAMP '2024-02-12') > 3 * 86400 THEN {{'i': 'stale_evidence', 'c': 25}} END,
   CASE WHEN has_conflict THEN {{'i': 'source_conflict', 'c': 35}} END, CASE WHEN NOT complete_coverage THEN {{'i': 'incomplete_coverage', 'c': 20}} END,
   CASE WHEN nu AND NOT has_unit THEN {{'i': 'missing_unit', 'c': 20}} END, CASE WHEN nm AND NOT has_market_context THEN {{'i': 'missing_market_context', 'c': 20}} END,
   CASE WHEN nz AND NOT has_timezone THEN {{'i': 'missing_timezone', 'c': 15}} END,
   CASE WHEN r.claim_type = 'calculation' AND NOT calculation_verified THEN {{'i': 'unverified_calculation', 'c': 35}} END], lambda e: e IS NOT NULL) AS hits FROM inputs i CROSS JOIN req r),
g1 AS (SELECT *, list_transform(hits, lambda e: e.i) AS names, greatest(0, 100 - coalesce(list_sum(list_transform(hits, lambda e: e.c)), 0)) AS score FROM g0),
gate AS (SELECT *, CASE WHEN claim_type IN ('numeric_fact', 'calculation') AND list_has_any(names, ['no_evidence', 'missing_unit', 'missing_market_context', 'missing_observation_time', 'unverified_calculation'])
     THEN 'refuse_numeric_claim' WHEN list_has_any(names, ['no_evidence', 'source_conflict']) THEN 'hold' WHEN score >= 85 AND len(names) = 0 THEN 'release'
     WHEN score >= 55 THEN 'release_with_warning' ELSE 'hold' END AS decision FROM g1)"""


@register("quality_gate", f"""WITH {GATE_SQL}, rat(decision, rationale) AS (VALUES {sql_rows(RATIONALES)}), warn(i, w) AS (VALUES {sql_rows(WARNINGS)})
SELECT question_id, claim_type, CAST(score AS INTEGER) AS score, decision, rationale, array_to_string(list_sort(list_distinct(names)), '|') AS issues,
  coalesce((SELECT string_agg(w, '|' ORDER BY w) FROM warn WHERE list_contains(names, i)), '') AS warnings FROM gate JOIN rat USING (decision)""")
def _quality_gate(spark, sf_dir):
    out = assessed(spark, sf_dir)
    return out.select("question_id", "claim_type", "score", "decision", "rationale",
                      joined(F.array_sort("issues")).alias("issues"), joined(F.array_sort("warnings")).alias("warnings"))


@register("confidence_from_evidence", """WITH r AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS p,
  bool_or(coalesce(toxic, 0) = 1) AND length(source) = 4 AS conflict FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
SELECT source, CASE WHEN n = 0 OR conflict OR length(source) % 7 = 0 THEN 'low' WHEN p >= 1 AND n >= 2 THEN 'high' WHEN p >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM r""")
def _confidence_evidence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = docs.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("p"),
        F.bool_or(F.coalesce("toxic", F.lit(0)) == 1).alias("toxic"))
    return out.select("source", confidence_from_evidence(
        F.col("n"), F.col("p"), F.col("toxic") & (F.length("source") == 4), F.length("source") % 7 == 0).alias("confidence"))


# ---- retrieval attempts: one per event, walked per user -------------------------------------
STATUS = ("success", "unauthorized", "success", "rate_limited", "success", "unavailable", "success")


def attempts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    status = nth(STATUS, i)
    ok = status == "success"
    records_ = F.when(ok, F.pmod(i, F.lit(3))).otherwise(0)
    return ev.select(
        F.col("user_id").alias("question_id"), i.alias("pos"), status.alias("fetch_status"), records_.alias("records"),
        F.when(F.pmod(i, F.lit(11)) == 0, F.least(records_, F.lit(1))).otherwise(0).alias("primary_records"))


ATTEMPTS_SQL = f"""att AS (SELECT user_id AS question_id, event_id AS pos, {sql_nth(STATUS, 'event_id')} AS fetch_status FROM events),
att2 AS (SELECT *, CASE WHEN fetch_status = 'success' THEN pos % 3 ELSE 0 END AS records FROM att),
attempts AS (SELECT *, CASE WHEN pos % 11 = 0 THEN least(records, 1) ELSE 0 END AS primary_records FROM att2),
running AS (SELECT *, coalesce(sum(records) OVER w, 0) AS r, coalesce(max(primary_records) OVER w, 0) AS p FROM attempts
   WINDOW w AS (PARTITION BY question_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@register("until_satisfied", f"WITH {ATTEMPTS_SQL} SELECT question_id, pos FROM running WHERE NOT (r >= 5 AND p > 0)")
def _until_satisfied(spark, sf_dir):
    return until_satisfied(attempts(spark, sf_dir), min_records=5).select("question_id", "pos")


@register("until_enough_records", f"WITH {ATTEMPTS_SQL} SELECT question_id, pos FROM running WHERE NOT (r >= 3)")
def _until_enough(spark, sf_dir):
    return until_satisfied(attempts(spark, sf_dir), min_records=3, require_primary=False).select("question_id", "pos")


@register("attempt_outcomes", f"""WITH {ATTEMPTS_SQL}, o AS (SELECT question_id, count(*) AS attempt_count, count(*) FILTER (WHERE fetch_status = 'success') AS success_count,
  CAST(sum(records) AS BIGINT) AS record_count, CAST(sum(primary_records) AS BIGINT) AS primary_count FROM attempts GROUP BY 1)
SELECT *, record_count > 0 AS succeeded, CASE WHEN record_count = 0 THEN 'No accessible provider returned usable evidence.'
  WHEN primary_count = 0 THEN 'No primary-source record was available.' END AS warning FROM o""")
def _attempt_outcomes(spark, sf_dir):
    return attempt_outcomes(attempts(spark, sf_dir))


@register("page_coverage", """WITH p AS (SELECT l_orderkey AS request_id, l_linenumber, CAST(l_quantity AS BIGINT) AS row_count, (l_linenumber - 1) * 25 AS off, 25 * (l_orderkey % 8) AS total FROM lineitem),
g AS (SELECT request_id, count(*) AS page_count, CAST(sum(row_count) AS BIGINT) AS rows_received, max(off + row_count) AS reached, max(total) AS total FROM p GROUP BY 1)
SELECT request_id, page_count, rows_received, reached, CASE WHEN rows_received > 150 THEN 'over_row_limit' WHEN reached >= total THEN 'complete' ELSE 'partial' END AS coverage FROM g""")
def _page_coverage(spark, sf_dir):
    pages = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), F.col("l_quantity").cast("bigint").alias("row_count"),
        ((F.col("l_linenumber") - 1) * 25).alias("offset"), (F.pmod("l_orderkey", F.lit(8)) * 25).alias("total"))
    return page_coverage(pages, max_rows=150).drop("total")


@register("number_sources", """SELECT source AS question_id, doc_id AS pos, 'source-' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS source_id FROM documents""")
def _number_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("question_id"), F.col("doc_id").alias("pos"))
    return number_sources(docs, chunk_size=64).select("question_id", "pos", "source_id")


# ---- drafts and releases -----------------------------------------------------------------------
def payload_records(spark, sf_dir):
    rec = records(spark, sf_dir)
    i = F.col("pos")
    some = lambda n, text: F.when(F.pmod(i, F.lit(n)) == 1, F.concat(F.lit(text), i.cast("string")))
    none = F.lit(None).cast("string")
    return rec.withColumns({
        "claim_type": nth(CLAIM_TYPES, F.length("question_id")), "direct_answer": some(2, "direct "), "summary": some(3, "summary "),
        "answer": some(5, "answer "), "simple_explanation": F.lit(""), "explanation": some(4, "because "),
        "value": i.cast("string"), "unit": F.lit("MWh"), "market": none, "timezone": F.lit("UTC"), "interval": none})


DRAFT_SQL = f"""{INPUTS_SQL}, firsts AS (SELECT question_id, min(pos) AS pos, count(*) AS source_count FROM rec GROUP BY 1),
drafts AS (SELECT question_id, source_count, CAST(pos AS VARCHAR) AS value, {sql_nth(CLAIM_TYPES, 'length(question_id)')} AS claim_type,
  CASE WHEN pos % 2 = 1 THEN 'direct ' || pos WHEN pos % 3 = 1 THEN 'summary ' || pos WHEN pos % 5 = 1 THEN 'answer ' || pos
       ELSE 'Authoritative evidence was retrieved successfully.' END AS direct_answer,
  CASE WHEN pos % 4 = 1 THEN 'because ' || pos ELSE 'The answer is based on the highest-ranked accessible evidence returned by the research pipeline.' END AS simple_explanation FROM firsts)"""


@register("draft_answers", f"""WITH {DRAFT_SQL} SELECT question_id, claim_type, source_count, value, direct_answer, simple_explanation,
  claim_type IN ('explanation', 'analyst_inference', 'forecast') AS is_inference FROM drafts""")
def _draft_answers(spark, sf_dir):
    return draft_answers(payload_records(spark, sf_dir)).select(
        "question_id", "claim_type", "source_count", "value", "direct_answer", "simple_explanation", "is_inference")


@register("release_decision", f"""WITH {GATE_SQL}, firsts AS (SELECT question_id, min(pos) AS pos FROM rec GROUP BY 1),
r AS (SELECT g.question_id, g.claim_type, score, decision, CASE WHEN pos % 2 = 1 THEN 'direct ' || pos END AS d FROM gate g JOIN firsts USING (question_id))
SELECT question_id, claim_type, CASE decision WHEN 'release' THEN 'answered' WHEN 'release_with_warning' THEN 'answered_with_warning' ELSE 'held' END AS status,
  CASE WHEN decision IN ('hold', 'refuse_numeric_claim') THEN 'insufficient' WHEN score >= 90 THEN 'high' WHEN score >= 70 THEN 'medium' ELSE 'low' END AS confidence,
  decision IN ('release', 'release_with_warning') AND d IS NOT NULL AS claim_released,
  CASE decision WHEN 'hold' THEN '{HELD_ANSWER}' WHEN 'refuse_numeric_claim' THEN '{REFUSED_ANSWER}'
    ELSE coalesce(d, 'The requested information could not be verified from accessible authoritative sources.') END AS direct_answer FROM r""")
def _release_decision(spark, sf_dir):
    first = records(spark, sf_dir).groupBy("question_id").agg(F.min("pos").alias("p")).select(
        "question_id", F.when(F.col("p") % 2 == 1, F.concat(F.lit("direct "), F.col("p").cast("string"))).alias("direct_answer"))
    drafts = assessed(spark, sf_dir).join(first, "question_id").withColumns({
        "simple_explanation": F.lit("e"), "retrieval_warning": F.lit(None).cast("string")})
    return release_decision(drafts).select("question_id", "claim_type", "status", "confidence", "claim_released", "direct_answer")


# ---- answers, claims and sources: one answer per conversation -----------------------------------
def answer_tables(spark, sf_dir):
    """Answers (conversations), claims (assistant turns), citations and sources (user turns)."""
    conv = table(spark, sf_dir, "conversations")
    c, t = F.col("conv_id"), F.col("turn")
    answers = conv.groupBy(c.alias("answer_id")).agg(F.min_by("text", "turn").alias("question"), F.count("*").alias("n"))
    a = F.col("answer_id")
    answers = answers.withColumns({
        "question": F.when(a % 13 == 0, "  ").otherwise(F.col("question")),
        "direct_answer": F.when(a % 17 == 0, "").otherwise("yes"), "simple_explanation": F.lit("because"),
        "decision": F.when(a % 5 == 0, "hold").when(a % 5 == 1, "refuse_numeric_claim").otherwise("release"),
        "limitation_count": a % 3})
    claims = conv.where("role = 'assistant'").select(
        c.alias("answer_id"), F.concat(F.lit("claim-"), t.cast("string")).alias("claim_id"), nth(CLAIM_TYPES, c + t).alias("claim_type"),
        F.when(t % 4 != 1, t.cast("string")).alias("value"), F.when(c % 2 == 0, "MWh").otherwise("").alias("unit"),
        F.when(c % 3 != 0, "CAISO").alias("market"), F.lit("UTC").alias("timezone"), (t % 2 == 0).alias("is_inference"))
    cited = conv.where("role = 'assistant' and (conv_id + turn) % 3 <> 0").select(
        c.alias("answer_id"), F.concat(F.lit("claim-"), t.cast("string")).alias("claim_id"),
        F.explode(F.array(F.concat(F.lit("source-"), (t - 1).cast("string")), F.concat(F.lit("source-"), (t + 1).cast("string")))).alias("source_id"))
    sources = conv.where("role = 'user'").select(
        c.alias("answer_id"), F.concat(F.lit("source-"), t.cast("string")).alias("source_id"), (t % 4 == 0).alias("is_primary"))
    return answers, claims, cited, sources


ANSWERS_SQL = f"""ans AS (SELECT conv_id AS answer_id, CASE WHEN conv_id % 13 = 0 THEN '  ' ELSE arg_min(text, turn) END AS question,
   CASE WHEN conv_id % 17 = 0 THEN '' ELSE 'yes' END AS direct_answer, conv_id % 5 < 2 AS blocked, conv_id % 3 AS limitation_count FROM conversations GROUP BY conv_id),
claims AS (SELECT conv_id AS answer_id, turn, 'claim-' || turn AS claim_id, {sql_nth(CLAIM_TYPES, 'conv_id + turn')} AS claim_type, turn % 4 <> 1 AS has_value,
   conv_id % 2 = 0 AS has_unit, conv_id % 3 <> 0 AS has_market, turn % 2 = 0 AS is_inference, (conv_id + turn) % 3 <> 0 AS cites FROM conversations WHERE role = 'assistant'),
cited AS (SELECT answer_id, claim_id, 'source-' || (turn - 1) AS source_id FROM claims WHERE cites UNION ALL SELECT answer_id, claim_id, 'source-' || (turn + 1) FROM claims WHERE cites),
sources AS (SELECT conv_id AS answer_id, 'source-' || turn AS source_id, turn % 4 = 0 AS is_primary FROM conversations WHERE role = 'user'),
missing AS (SELECT * FROM cited c WHERE NOT EXISTS (SELECT 1 FROM sources s WHERE s.answer_id = c.answer_id AND s.source_id = c.source_id)),
errs AS (SELECT DISTINCT answer_id, claim_id, 'unknown_sources' AS error FROM missing
  UNION ALL SELECT answer_id, claim_id, 'missing_unit' FROM claims WHERE claim_type IN ('numeric_fact', 'calculation') AND has_value AND NOT has_unit
  UNION ALL SELECT answer_id, claim_id, 'missing_market' FROM claims WHERE claim_type IN ('numeric_fact', 'calculation') AND has_value AND NOT has_market
  UNION ALL SELECT answer_id, claim_id, 'unsupported_inference' FROM claims WHERE is_inference AND NOT cites)"""


@register("missing_sources", f"WITH {ANSWERS_SQL} SELECT answer_id, claim_id, source_id FROM missing")
def _missing_sources(spark, sf_dir):
    _, _, cited, sources = answer_tables(spark, sf_dir)
    return missing_sources(cited, sources).select("answer_id", "claim_id", "source_id")


@register("claim_errors", f"WITH {ANSWERS_SQL} SELECT answer_id, claim_id, error FROM errs")
def _claim_errors(spark, sf_dir):
    _, claims, cited, sources = answer_tables(spark, sf_dir)
    return claim_errors(claims, cited, sources)


@register("validate_answers", f"""WITH {ANSWERS_SQL}, e AS (SELECT answer_id, count(*) AS n FROM errs GROUP BY 1), s AS (SELECT answer_id, count(*) AS n, count(*) FILTER (WHERE is_primary) AS p FROM sources GROUP BY 1),
v AS (SELECT a.answer_id, coalesce(e.n, 0) AS claim_error_count, coalesce(s.n, 0) AS sn, coalesce(s.p, 0) AS sp, concat_ws('|', CASE WHEN trim(question) = '' THEN 'empty_question' END,
   CASE WHEN direct_answer = '' THEN 'empty_answer' END, CASE WHEN blocked AND limitation_count = 0 THEN 'unexplained_block' END) AS answer_errors
   FROM ans a LEFT JOIN e USING (answer_id) LEFT JOIN s USING (answer_id))
SELECT answer_id, claim_error_count, answer_errors, concat_ws('|', CASE WHEN sp = 0 THEN 'no_primary_source' END, CASE WHEN sn < 2 THEN 'fewer_than_two_sources' END) AS answer_warnings,
  answer_errors = '' AND claim_error_count = 0 AS valid FROM v""")
def _validate_answers(spark, sf_dir):
    out = validate_answers(*answer_tables(spark, sf_dir))
    return out.select("answer_id", "claim_error_count", joined(F.col("answer_errors")).alias("answer_errors"),
                      joined(F.col("answer_warnings")).alias("answer_warnings"), "valid")


def turn_pairs(spark, sf_dir):
    """A user turn with the assistant turn that follows it."""
    conv = table(spark, sf_dir, "conversations")
    asked = conv.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    said = conv.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return asked.join(said, ["conv_id", "turn"])


PAIRS_SQL = f"""pairs AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS reply FROM conversations u JOIN conversations a
   ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'),
over AS (SELECT *, {answer_terms_sql('question')} AS qt, {answer_terms_sql('reply')} AS rt FROM pairs),
overlap AS (SELECT *, len(list_filter(qt, lambda w: list_contains(rt, w))) / greatest(len(qt), 1) AS share FROM over)"""


@register("term_overlap", f"WITH {PAIRS_SQL} SELECT conv_id, turn, round(share, 6) AS overlap, share < 0.35 AS off_topic FROM overlap")
def _term_overlap(spark, sf_dir):
    share = term_overlap(F.col("question"), F.col("reply"))
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", F.round(share, 6).alias("overlap"), (share < 0.35).alias("off_topic"))


def packed_answers(spark, sf_dir):
    """Answers with claim and source arrays in the row, several of them broken."""
    c, t = F.col("conv_id"), F.col("turn")
    claim = lambda text, ids, kind: F.struct(F.lit(text).alias("text"), ids.alias("source_ids"), F.lit(kind).alias("claim_type"))
    ids = lambda *v: F.array(*[F.lit(i) for i in v]).cast("array<int>")
    source = lambda i, url: F.struct(F.lit(i).alias("source_id"), url.alias("url"))
    k = c + t
    claims = (F.when(k % 6 == 1, F.array(claim("a", ids(1), "fact"), claim(" ", ids(2), "fact")))
              .when(k % 6 == 2, F.array(claim("a", ids(1, 9), "fact")))
              .when(k % 6 == 3, F.array(claim("a", ids(1), "fact"), claim("b", ids(), "context")))
              .when(k % 6 == 4, F.filter(F.array(claim("a", ids(1), "fact")), lambda x: F.lit(False)))
              .otherwise(F.array(claim("a", ids(1, 2), "fact"))))
    sources = F.array(source(1, F.lit("https://a.org")), source(2, F.when(k % 7 == 3, "https://a.org").otherwise("https://b.org")))
    status = F.when(k % 11 == 4, "held").when(k % 19 == 5, "odd").otherwise("answered")
    return turn_pairs(spark, sf_dir).select(
        c, t, "question", F.when(k % 23 == 6, "").otherwise(F.concat_ws(" ", "question", "reply")).alias("direct_answer"),
        F.lit("").alias("explanation"), status.alias("status"), claims.alias("claims"), sources.alias("sources"))


@register("validate_citations", f"""WITH {PAIRS_SQL},
k AS (SELECT *, conv_id + turn AS k FROM over),
m AS (SELECT *, CASE WHEN k % 11 = 4 THEN 'held' WHEN k % 19 = 5 THEN 'odd' ELSE 'answered' END AS status,
  CASE WHEN k % 23 = 6 THEN 0 ELSE len(qt) / greatest(len(qt), 1) END AS share FROM k),
e AS (SELECT *, CASE WHEN status = 'odd' THEN 'invalid_status' WHEN status = 'held' THEN NULL WHEN k % 23 = 6 THEN 'missing_answer' WHEN k % 6 = 4 THEN 'no_claims'
    WHEN k % 6 = 1 THEN 'blank_claim' WHEN k % 6 = 2 THEN 'unknown_source' WHEN k % 6 = 3 THEN 'uncited_claim' END AS fault FROM m)
SELECT conv_id, turn, concat_ws('|', fault, CASE WHEN status <> 'held' AND share < 0.35 THEN 'low_overlap' END, CASE WHEN status <> 'held' AND k % 7 = 3 THEN 'duplicate_sources' END,
  CASE WHEN status <> 'held' AND k % 6 = 4 THEN 'nothing_cited' END, CASE WHEN status <> 'held' AND k % 6 = 2 THEN 'invalid_source_ids' END) AS errors,
  CASE WHEN status = 'held' THEN 0 ELSE CAST(share AS DOUBLE) END AS overlap FROM e""")
def _validate_citations(spark, sf_dir):
    out = validate_citations(packed_answers(spark, sf_dir))
    return out.select("conv_id", "turn", joined(F.col("errors")).alias("errors"), "overlap")


@register("ids_subset", """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'nothing_cited' WHEN turn % 3 = 1 THEN 'unknown_ids' ELSE 'ok' END AS state, conv_id % 2 <> 0 AS urls_unique FROM conversations""")
def _ids_subset(spark, sf_dir):
    t = F.col("turn")
    cited = F.when(t % 3 == 2, F.array().cast("array<bigint>")).when(t % 3 == 1, F.array(t, t + 50)).otherwise(F.array(t))
    available = F.sequence(F.lit(0).cast("bigint"), t)
    urls = F.array(F.lit("a"), F.when(F.col("conv_id") % 2 == 0, "a").otherwise("b"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ids_subset(cited, available).alias("state"),
                                                        urls_unique(urls).alias("urls_unique"))


@register("clean_claims", """WITH c AS (SELECT conv_id, turn, list_filter(list_distinct([turn, 0, turn + 1, turn, 99]), lambda i: i BETWEEN 1 AND 3) AS ids,
  CASE turn % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'inference' WHEN 2 THEN 'context' ELSE 'fact' END AS claim_type FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(ids), ',') AS source_ids, claim_type FROM c WHERE claim_type <> 'fact' OR len(ids) > 0""")
def _clean_claims(spark, sf_dir):
    t = F.col("turn").cast("int")
    claims = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.array(t, F.lit(0), t + 1, t, F.lit(99)).alias("source_ids"),
        nth((" Fact", "inference", "opinion", "fact"), t).alias("claim_type"), F.lit(3).alias("max_source_id"))
    return clean_claims(claims).select("conv_id", "turn", joined(F.array_sort("source_ids"), ",").alias("source_ids"), "claim_type")
