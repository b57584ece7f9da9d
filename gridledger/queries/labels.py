"""Classification, routing and planning of the conversation questions."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridledger import dims
from gridledger.functions import fixed_values as fv
from gridledger.operators.joins import match_providers, match_sources, restrict_domains
from gridledger.operators.labels import (
    CROSS_CHECK_TOPICS, CURRENT_TOPICS, EXACT_TOPICS, STRUCTURED_INTENTS, WEB_INTENTS,
    classify_questions, parse_market_questions, plan_capabilities, plan_research, plan_retrieval,
    route_questions, with_source_intent)
from gridledger.plans.dispatch import assign_pathways, research_explanation
from gridledger.queries.base import (
    QUESTIONS_SQL, joined, norm_sql, nth, questions, register, rules_cte, sql_list, sql_nth,
    sql_rows)
from gridledger.queries.series import OPERATING_SQL
from gridledger.queries.text import ENTITY_CASE, FRESH_SQL


def argmax_sql(name: str, vocab: str, default: str) -> str:
    """CTE: label with most matching terms, then longest term, then order."""
    return f"""{name}_m AS (SELECT question_id, label, ord, count(*) AS n, max(length(term)) AS longest
   FROM questions JOIN {vocab} ON contains(lower(question), term) GROUP BY 1, 2, 3),
{name} AS (SELECT q.question_id, coalesce(m.label, '{default}') AS label FROM questions q LEFT JOIN
   (SELECT * FROM {name}_m QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY n DESC, longest DESC, ord) = 1) m USING (question_id))"""


CLASSIFIED_SQL = ", ".join([
    QUESTIONS_SQL, rules_cte("v_com", fv.COMMODITY_TERMS), rules_cte("v_top", fv.TOPIC_TERMS),
    rules_cte("v_geo", fv.GEOGRAPHY_TERMS), argmax_sql("com", "v_com", "unknown"),
    argmax_sql("top", "v_top", "general"), argmax_sql("geo", "v_geo", "unknown"),
    """classified AS (SELECT question_id, question, com.label AS commodity, top.label AS topic, geo.label AS geography
   FROM questions JOIN com USING (question_id) JOIN top USING (question_id) JOIN geo USING (question_id))"""])


@register("classify_questions", f"""WITH {CLASSIFIED_SQL}
SELECT question_id, commodity, topic, geography, concat_ws('|', {ENTITY_CASE}) AS entities,
  array_to_string(list_filter(regexp_extract_all(lower(question), '[a-z0-9_-]+'), lambda w: length(w) >= 3), ' ') AS keywords FROM classified""")
def _classify(spark, sf_dir):
    out = classify_questions(questions(spark, sf_dir))
    return out.select("question_id", "commodity", "topic", "geography", joined(F.col("entities")).alias("entities"),
                      joined(F.col("keywords"), " ").alias("keywords"))


def _in(column: str, names) -> str:
    return f"{column} IN ({', '.join(repr(n) for n in names)})"


CAPABILITY_SQL = f"""CASE WHEN {_in('topic', EXACT_TOPICS)} THEN 'structured_market_data' END,
  CASE WHEN topic IN ('asset_status', 'outage') THEN 'asset_status' END,
  CASE WHEN topic IN ('regulatory', 'policy') THEN 'regulatory_documents' END,
  CASE WHEN topic = 'weather' THEN 'weather_data' END,
  CASE WHEN topic IN ('company', 'project', 'news') THEN 'company_news' END, 'general_web_research'"""


@register("plan_capabilities", f"""WITH {CLASSIFIED_SQL}
SELECT question_id, concat_ws('|', {CAPABILITY_SQL}) AS capabilities, {_in('topic', EXACT_TOPICS)} AS needs_exact,
  {_in('topic', CURRENT_TOPICS)} AS needs_current, {_in('topic', CROSS_CHECK_TOPICS)} AS needs_cross_check,
  CASE WHEN {_in('topic', CROSS_CHECK_TOPICS)} THEN 2 ELSE 1 END AS minimum_sources FROM classified""")
def _capabilities(spark, sf_dir):
    out = plan_capabilities(classify_questions(questions(spark, sf_dir)))
    return out.select("question_id", joined(F.col("capabilities")).alias("capabilities"), "needs_exact",
                      "needs_current", "needs_cross_check", "minimum_sources")


PROVIDERS_SQL = "providers(provider_id, provider_name, rank, is_primary, access, commodities, topics, places, capabilities, kinds) AS (VALUES " + ", ".join(
    f"('{p[0]}', '{p[1]}', {p[2]}, {str(p[3]).lower()}, '{p[4]}', {sql_list(p[6])}, {sql_list(p[7])}, {sql_list(p[8])}, {sql_list(p[9])}, {sql_list(p[10])})"
    for p in dims.provider_rows()) + ")"
MATCHED_SQL = f"""{PROVIDERS_SQL},
need AS (SELECT *, list_filter([{CAPABILITY_SQL}], lambda c: c IS NOT NULL) AS wanted FROM classified),
matched AS (SELECT n.question_id, p.*, row_number() OVER (PARTITION BY n.question_id ORDER BY rank, NOT is_primary, provider_name) - 1 AS provider_pos
   FROM need n JOIN providers p ON (list_contains(p.commodities, n.commodity) OR n.commodity = 'unknown')
    AND (list_contains(p.topics, n.topic) OR n.topic = 'general')
    AND (list_contains(p.places, n.geography) OR n.geography = 'unknown' OR list_contains(p.places, 'global'))
    AND list_has_any(n.wanted, p.capabilities) AND {{licensed}})"""


@register("match_providers", f"""WITH {CLASSIFIED_SQL}, {MATCHED_SQL.format(licensed="p.access <> 'optional_licensed'")}
SELECT q.question_id, coalesce(string_agg(m.provider_id, '|' ORDER BY provider_pos), '') AS providers
FROM questions q LEFT JOIN matched m USING (question_id) GROUP BY 1""")
def _match_providers(spark, sf_dir):
    out = match_providers(plan_capabilities(classify_questions(questions(spark, sf_dir))))
    return out.select("question_id", joined(F.col("providers")).alias("providers"))


METHODS_SQL = """list_transform(kinds, lambda k: CASE k WHEN 'structured_api' THEN 'structured_api' WHEN 'document_search' THEN 'document_search'
   WHEN 'web_research' THEN 'official_web' ELSE 'bulk_download' END)"""
RETRIEVAL_SQL = f"""m1 AS (SELECT *, {METHODS_SQL} AS raw, question_id % 2 = 0 AS has_key FROM matched),
m2 AS (SELECT *, list_filter(raw, lambda m: NOT (m = 'structured_api' AND access = 'public_api_key' AND NOT has_key))
    || CASE WHEN is_primary AND NOT list_contains(raw, 'official_web') THEN ['official_web'] ELSE [] END AS methods FROM m1),
steps AS (SELECT question_id, provider_pos, provider_id, unnest(methods) AS method, generate_subscripts(methods, 1) - 1 AS method_pos
   FROM m2 WHERE access <> 'optional_licensed' OR question_id % 4 = 0)"""


@register("plan_retrieval", f"""WITH {CLASSIFIED_SQL}, {MATCHED_SQL.format(licensed='true')}, {RETRIEVAL_SQL}
SELECT question_id, provider_pos, provider_id, method, method_pos, 'use' AS state FROM steps
UNION ALL SELECT question_id, provider_pos, provider_id, NULL, 0, 'skip' FROM m2 WHERE access = 'optional_licensed' AND question_id % 4 <> 0""")
def _plan_retrieval(spark, sf_dir):
    out = match_providers(plan_capabilities(classify_questions(questions(spark, sf_dir))), include_licensed=True)
    i = F.col("question_id")
    none = F.array().cast("array<string>")
    out = out.withColumns({
        "credentials": F.when(F.pmod(i, F.lit(2)) == 0, F.array(F.lit("eia_api"))).otherwise(none),
        "licenses": F.when(F.pmod(i, F.lit(4)) == 0, F.array(F.lit("woodmac_optional"))).otherwise(none)})
    steps = plan_retrieval(out)
    return steps.select("question_id", "provider_pos", "provider_id", "method", "method_pos",
                        F.when(F.col("skip_reason").isNull(), "use").otherwise("skip").alias("state"))


# ---- routing by whole words ----------------------------------------------------------
def _word_any(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, ' {t.replace('-', ' ')} ')" for t in terms) + ")"


GEO_SQL = "CASE " + " ".join(f"WHEN {_word_any('padded', terms)} THEN '{label}'" for label, terms in fv.ROUTE_GEOGRAPHY_TERMS) + " END"
ROUTE_ENTITY_SQL = "concat_ws('|', " + ", ".join(
    f"CASE WHEN contains(padded, ' {e.replace('-', ' ')} ') THEN '{e}' END" for e in fv.ROUTE_ENTITIES) + ")"
ROUTED_SQL = f"""{rules_cte('v_dom', fv.DOMAIN_TERMS)},
padded AS (SELECT question_id, question, {norm_sql('question')} AS n, ' ' || {norm_sql('question')} || ' ' AS padded FROM questions),
hits AS (SELECT question_id, label, ord, count(*) AS k FROM padded JOIN v_dom ON contains(padded, ' ' || {norm_sql('term')} || ' ') GROUP BY 1, 2, 3),
dom AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY k DESC, ord) = 1),
r0 AS (SELECT p.*, coalesce(dom.label, CASE WHEN {' OR '.join(f"contains(n, '{w}')" for w in fv.GENERAL_ENERGY_WORDS)} THEN 'general_energy' ELSE 'unknown' END) AS domain,
   {GEO_SQL} AS geography, {ROUTE_ENTITY_SQL} AS entities, {FRESH_SQL} AS freshness FROM padded p LEFT JOIN dom USING (question_id)),
routed AS (SELECT *, CASE WHEN domain = 'unknown' THEN 'clarification' WHEN {_in('domain', fv.DOCUMENT_DOMAINS)} THEN 'official_document'
   WHEN {' OR '.join(f"contains(n, '{t}')" for t in fv.EXPLAIN_TERMS)} THEN 'hybrid_research'
   WHEN domain = 'general_energy' THEN 'hybrid_research' ELSE 'structured_data' END AS mode FROM r0),
plans(domain, providers, planned) AS (VALUES {sql_rows([(d, '|'.join(r[1] for r in fv.ROUTE_PROVIDERS if r[0] == d), ','.join(f"{r[1]}:{n}:{r[2]}:{'+'.join(r[3])}" for n, r in enumerate((r for r in fv.ROUTE_PROVIDERS if r[0] == d), 1))) for d in dict.fromkeys(r[0] for r in fv.ROUTE_PROVIDERS)])})"""


def planned_text(planned):
    """provider:priority:role:modes of each planned provider."""
    return joined(F.transform(planned, lambda p: F.concat_ws(":", p["provider_id"], p["priority"], p["source_role"],
                                                             F.array_join(p["retrieval_modes"], "+"))), ",")


@register("route_questions", f"""WITH {QUESTIONS_SQL}, {ROUTED_SQL}
SELECT question_id, domain, mode, freshness, geography, entities, coalesce(providers, '') AS providers, coalesce(planned, '') AS planned,
  domain <> 'unknown' AND (mode = 'hybrid_research' OR {_in('domain', fv.CROSS_SOURCE_DOMAINS)}) AS cross_source
FROM routed LEFT JOIN plans USING (domain)""")
def _route(spark, sf_dir):
    out = route_questions(questions(spark, sf_dir))
    return out.select("question_id", "domain", "mode", "freshness", "geography", joined(F.col("entities")).alias("entities"),
                      joined(F.col("providers")).alias("providers"), planned_text(F.col("planned_providers")).alias("planned"), "cross_source")


PATHWAY_SQL = """CASE WHEN r.domain = 'unknown' THEN 'clarify' WHEN r.domain = 'nuclear' THEN 'reactors'
  WHEN r.domain = 'electricity_markets' AND o.series_id IS NOT NULL THEN 'operating'
  WHEN r.domain = 'electricity_markets' AND r.geography = 'california' THEN 'prices' ELSE 'research' END"""


@register("assign_pathways", f"""WITH {OPERATING_SQL}, {ROUTED_SQL}
SELECT r.question_id, {PATHWAY_SQL} AS pathway FROM routed r JOIN op o USING (question_id)""")
def _pathways(spark, sf_dir):
    return assign_pathways(questions(spark, sf_dir)).select("question_id", "pathway")


@register("research_explanation", f"""WITH {OPERATING_SQL}, {ROUTED_SQL}
SELECT r.question_id, 'This question was routed to the ' || r.domain || ' research pathway. The preferred evidence sequence is: '
  || replace(providers, '|', ', ') || '. A numerical or factual claim will not be published until the required source executors return validated evidence.' AS simple_explanation
FROM routed r JOIN op o USING (question_id) JOIN plans USING (domain) WHERE {PATHWAY_SQL} = 'research'""")
def _explanation(spark, sf_dir):
    out = assign_pathways(questions(spark, sf_dir)).where("pathway = 'research'")
    return research_explanation(out).select("question_id", "simple_explanation")


# ---- market questions: first rule wins --------------------------------------------------
def first_rule_sql(column: str, rules, default: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({column}, '{t}')" for t in terms) + f" THEN '{label}'"
                     for label, terms in rules)
    return f"CASE {whens} ELSE '{default}' END"


MARKET_SQL = f"""parsed AS (SELECT *, {first_rule_sql('lower(question)', fv.MARKET_RULES, 'GENERAL')} AS market,
  {first_rule_sql('lower(question)', fv.INTENT_RULES, 'general')} AS intent,
  CASE WHEN contains(lower(question), 'yesterday') THEN '2024-01-02' WHEN contains(lower(question), 'today') THEN '2024-01-03' END AS requested_date,
  len(regexp_extract_all(question, '{fv.NODE_PATTERN}')) AS node_count FROM questions)"""


@register("parse_market_questions", f"WITH {QUESTIONS_SQL}, {MARKET_SQL} SELECT question_id, market, intent, requested_date FROM parsed")
def _parse_market(spark, sf_dir):
    out = parse_market_questions(questions(spark, sf_dir))
    return out.select("question_id", "market", "intent", F.col("requested_date").cast("string").alias("requested_date"))


@register("plan_research", f"""WITH {QUESTIONS_SQL}, {MARKET_SQL},
p AS (SELECT *, {_in('intent', STRUCTURED_INTENTS)} AS s, {_in('intent', WEB_INTENTS)} AS w, market = 'CAISO' AND intent = 'price' AS prices FROM parsed)
SELECT question_id, CASE WHEN s AND w THEN 'hybrid' WHEN s THEN 'structured_first' ELSE 'web_first' END AS mode,
  CASE WHEN intent = 'general' THEN 0 ELSE 1 END AS minimum_primary, CASE WHEN w THEN 2 ELSE 1 END AS minimum_total,
  concat_ws('|', CASE WHEN prices THEN 'caiso_oasis' END, CASE WHEN contains(lower(question), 'diablo canyon') THEN 'nrc_reactor_status' END) AS connectors,
  concat_ws('|', CASE WHEN prices AND node_count = 0 THEN 'The requested price location is ambiguous.' END,
    CASE WHEN prices AND requested_date IS NULL THEN 'The requested market date is ambiguous.' END) AS warnings FROM p""")
def _plan_research(spark, sf_dir):
    out = plan_research(parse_market_questions(questions(spark, sf_dir)))
    return out.select("question_id", "mode", "minimum_primary", "minimum_total",
                      joined(F.col("connectors")).alias("connectors"), joined(F.col("warnings")).alias("warnings"))


POLICY_SQL = "policy(source_id, source_name, rank, markets, intents) AS (VALUES " + ", ".join(
    f"('{s}', '{n}', {r}, {sql_list(dims._list(m, dims.MARKETS))}, {sql_list(dims._list(i, dims.INTENTS))})"
    for s, n, r, _, _, m, i in dims.SOURCE_POLICY) + ")"


@register("match_sources", f"""WITH {QUESTIONS_SQL}, {MARKET_SQL}, {POLICY_SQL}
SELECT question_id, coalesce(string_agg(source_id, '|' ORDER BY rank, source_name), '') AS sources
FROM parsed LEFT JOIN policy ON list_contains(markets, market) AND list_contains(intents, intent) GROUP BY 1""")
def _match_sources(spark, sf_dir):
    out = match_sources(parse_market_questions(questions(spark, sf_dir)), dims.source_policy(spark))
    return out.select("question_id", joined(F.col("sources")).alias("sources"))


@register("restrict_domains", f"""WITH {QUESTIONS_SQL},
i AS (SELECT question_id, {first_rule_sql('lower(question)', fv.SOURCE_INTENT_RULES, 'general')} AS source_intent FROM questions),
d(source_intent, allowed_domains) AS (VALUES {sql_rows([(n, '|'.join(ds)) for n, ds in fv.INTENT_DOMAINS])})
SELECT question_id, source_intent, allowed_domains FROM i JOIN d USING (source_intent)""")
def _restrict_domains(spark, sf_dir):
    out = restrict_domains(with_source_intent(questions(spark, sf_dir)))
    return out.select("question_id", "source_intent", joined(F.col("allowed_domains")).alias("allowed_domains"))


@register("classify_documents", f"""WITH v(label, ord, term) AS (VALUES {sql_rows([(label, i, t) for i, (label, ts) in enumerate(fv.COMMODITY_TERMS) for t in ts])}),
d AS (SELECT doc_id, lower(text || ' ' || {sql_nth(tuple(t[1][0] for t in fv.COMMODITY_TERMS), 'doc_id')}) AS low FROM documents),
m AS (SELECT doc_id, label, ord, count(*) AS n, max(length(term)) AS longest FROM d JOIN v ON contains(low, term) GROUP BY 1, 2, 3)
SELECT doc_id, label AS commodity FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, longest DESC, ord) = 1""")
def _classify_documents(spark, sf_dir):
    from gridledger.queries.base import table

    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(
        F.col("text"), F.lit(" "), nth(tuple(t[1][0] for t in fv.COMMODITY_TERMS), F.col("doc_id"))).alias("question"))
    return classify_questions(docs).select("doc_id", "commodity")
