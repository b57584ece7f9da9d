"""Search results, page evidence and de-duplication."""
from __future__ import annotations

from pyspark.sql import functions as F

from gridledger import dims
from gridledger.functions import fixed_values as fv
from gridledger.functions.plan import compute_once
from gridledger.functions.urls import canonicalize_url, host
from gridledger.operators.evidence import (
    accept_validated, dedup_capped, greedy_dedup, group_candidates, limitations, merge_queries,
    merge_results, packet_rollup, page_gate, provider_counts, retained_rollup, score_discovery,
    score_page, validated_rollup, with_dedup_keys, with_plan_terms)
from gridledger.operators.gates import citation_release
from gridledger.operators.joins import join_authority
from gridledger.operators.ranking import cap_documents, one_per_domain, top_candidates, top_k
from gridledger.plans.evidence import cited_answers, collect, discover, evidence_batch, packet_status
from gridledger.queries.base import PHRASES, joined, nth, register, sql_list, sql_nth, squeeze_sql, table
from gridledger.queries.text import (
    AUTH_SQL, ENC, PAGE_TEXT_SQL, VARIED_SQL, page_bodies, results, varied_urls)
from gridledger.sources.web import extract_page_text

ENTITY_LISTS = ("Diablo Canyon|ERCOT", "Henry Hub", "CAISO|NP-15", "", "Brent|OPEC|Brent")
PLACES = ("California", "Texas|Europe", "", "New England")
DOMAINS = ("www.caiso.com|example.org", "EIA.gov", "", "example.com|stanford.edu")


def _split(c):
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|"))


def plans(spark, sf_dir):
    """One research plan per dozen pages."""
    q = table(spark, sf_dir, "pages").select(F.expr("page_id div 12").alias("question_id")).distinct()
    i = F.col("question_id")
    return q.select(
        i, nth(PHRASES, i).alias("question"), F.lit("price outlook").alias("intent"),
        _split(nth(ENTITY_LISTS, i)).alias("entities"), _split(nth(PLACES, i)).alias("geography"),
        _split(nth(DOMAINS, i)).alias("official_domains"),
        F.array(nth(PHRASES, i), F.concat(F.lit(" "), nth(PHRASES, i + 1)), F.lit(" "), nth(PHRASES, i)).alias("search_queries"))


def _list_sql(values, index):
    return f"list_filter(string_split({sql_nth(values, index)}, '|'), lambda v: v <> '')"


def tokens_sql(c: str) -> str:
    return (f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9][a-z0-9&.-]+'), lambda w: length(w) >= 3"
            f" AND NOT list_contains({sql_list(fv.SEARCH_STOPWORDS)}, w)))")


PLANS_SQL = f"""p0 AS (SELECT DISTINCT page_id // 12 AS question_id FROM pages),
p1 AS (SELECT question_id, {sql_nth(PHRASES, 'question_id')} AS question, {sql_nth(PHRASES, 'question_id + 1')} AS other,
   {_list_sql(ENTITY_LISTS, 'question_id')} AS entities, {_list_sql(PLACES, 'question_id')} AS geography, {_list_sql(DOMAINS, 'question_id')} AS official_domains FROM p0),
plans AS (SELECT *, {tokens_sql('question')} AS qt, {tokens_sql("array_to_string(entities, ' ')")} AS et, {tokens_sql("array_to_string(geography, ' ')")} AS gt,
   {tokens_sql("'price outlook'")} AS it FROM p1)"""


@register("merge_queries", f"""WITH {PLANS_SQL}
SELECT question_id, question || '|' || other || CASE WHEN len(official_domains) = 0 THEN '' ELSE '|' || array_to_string(list_transform(official_domains, lambda d: 'site:' || d || ' ' || question), '|') END AS queries FROM plans""")
def _merge_queries(spark, sf_dir):
    return merge_queries(plans(spark, sf_dir)).select("question_id", joined(F.col("queries")).alias("queries"))


# ---- results of two providers: the second repeats URLs with a tracking parameter ---------
def web_and_news(spark, sf_dir):
    web = results(spark, sf_dir).select("question_id", "pos", "title", "snippet", "url").withColumns({
        "provider": F.lit("web"), "query": nth(PHRASES, F.col("pos")),
        "published_at": F.when(F.pmod("pos", F.lit(3)) == 0, "2024-01-01")})
    glue = F.when(F.col("url").contains("?"), "&").otherwise("?")
    news = results(spark, sf_dir).select(
        "question_id", (F.col("pos") + 1_000_000).alias("pos"), F.col("snippet").alias("title"), F.col("title").alias("snippet"),
        F.when(F.col("url").contains("#"), F.col("url")).otherwise(F.concat("url", glue, F.lit("utm_source=news"))).alias("url"),
        F.lit("news").alias("provider"), nth(PHRASES, F.expr("pos div 2")).alias("query"), F.lit("en").alias("language"))
    return merge_results(web, news)


CANON_SQL = f"""canon AS (SELECT page_id, CASE WHEN scheme = '' OR host = '' THEN url ELSE scheme || '://' || net
   || CASE WHEN clean_path = '/' THEN '/' ELSE rtrim(clean_path, '/') END
   || CASE WHEN len(pairs) = 0 THEN '' ELSE '?' || array_to_string(list_transform(pairs, lambda e: {ENC.format('e.k')} || '=' || {ENC.format('e.v')}), '&') END END AS canonical, host FROM normal)"""
MERGED_SQL = f"""{VARIED_SQL}, {CANON_SQL},
merged AS (SELECT page_id // 12 AS question_id, page_id AS pos, {sql_nth(PHRASES, 'page_id * 3')} AS title, {sql_nth(PHRASES, 'page_id + 5')} AS snippet, canonical AS url, host,
   'web' AS provider, {sql_nth(PHRASES, 'page_id')} AS query, page_id % 3 = 0 AS dated FROM canon
 UNION ALL SELECT page_id // 12, page_id + 1000000, {sql_nth(PHRASES, 'page_id + 5')}, {sql_nth(PHRASES, 'page_id * 3')},
   CASE WHEN canonical = 'no scheme/path' THEN 'no scheme/path?utm_source=news' ELSE canonical END, host, 'news', {sql_nth(PHRASES, 'page_id // 2')}, false FROM canon)"""


@register("merge_results", f"WITH {MERGED_SQL} SELECT question_id, pos, provider, url, query FROM merged")
def _merge_results(spark, sf_dir):
    return web_and_news(spark, sf_dir).select("question_id", "pos", "provider",
                                              canonicalize_url(F.col("url")).alias("url"), "query")


@register("provider_counts", f"""WITH {MERGED_SQL} SELECT question_id, provider, count(*) AS result_count, count(DISTINCT url) AS distinct_urls FROM merged GROUP BY 1, 2
UNION ALL SELECT question_id, NULL, count(*), count(DISTINCT url) FROM merged GROUP BY 1""")
def _provider_counts(spark, sf_dir):
    return provider_counts(web_and_news(spark, sf_dir))


ROUND = "CAST(round(CAST({0} AS DECIMAL(28,9)), 3) AS DOUBLE)"
DISC_SQL = f"""{MERGED_SQL}, {AUTH_SQL}, {PLANS_SQL},
tiers AS (SELECT host, arg_min(tier, ord) AS tier, arg_min(organization, ord) AS organization FROM (SELECT DISTINCT host FROM canon)
   JOIN a ON host = domain OR ends_with(host, '.' || domain) GROUP BY host),
dx AS (SELECT m.*, t.tier, p.* EXCLUDE (question_id), lower(m.title || ' ' || m.snippet || ' ' || m.url) AS txt,
   t.tier IS NOT NULL OR len(list_filter(official_domains, lambda d: m.host = regexp_replace(lower(d), '^www\\.', '') OR ends_with(m.host, '.' || regexp_replace(lower(d), '^www\\.', '')))) > 0 AS official
   FROM merged m JOIN plans p USING (question_id) LEFT JOIN tiers t ON t.host = m.host),
disc AS (SELECT *, {ROUND.format('''1.2 * len(list_filter(qt, lambda w: contains(txt, w))) + 2.5 * len(list_filter(et, lambda w: contains(txt, w)))
   + 2.0 * len(list_filter(gt, lambda w: contains(txt, w))) + 0.75 * len(list_filter(it, lambda w: contains(txt, w)))
   + CASE WHEN official THEN 12 ELSE 0 END + CASE tier WHEN 'controlling' THEN 10 WHEN 'primary' THEN 7 ELSE 0 END
   + CASE WHEN ends_with(host, '.gov') THEN 10 ELSE 0 END + CASE WHEN ends_with(host, '.edu') THEN 5 ELSE 0 END
   + 4 * len(list_filter(entities, lambda e: contains(lower(title), lower(e)))) + 3 * len(list_filter(geography, lambda e: contains(lower(title), lower(e))))
   + CASE WHEN dated THEN 1 ELSE 0 END + least(length(snippet) / 500.0, 1.5)
   - CASE WHEN regexp_matches(txt, \'''' + fv.LOW_VALUE_PATTERN + '''\') THEN 15 ELSE 0 END''')} AS score FROM dx)"""


def scored(spark, sf_dir):
    terms = with_plan_terms(plans(spark, sf_dir))
    rows = compute_once(web_and_news(spark, sf_dir), {"url": canonicalize_url(F.col("url"))})
    rows = join_authority(compute_once(rows, {"host": host(F.col("url"))}), "host", dims.authorities(spark))
    return score_discovery(rows.join(terms.drop("search_queries"), "question_id"))


@register("discovery_score", f"WITH {DISC_SQL} SELECT question_id, pos, url, official, score FROM disc")
def _discovery_score(spark, sf_dir):
    return scored(spark, sf_dir).select("question_id", "pos", "url", "official", "score")


GROUPED_SQL = """best AS (SELECT * FROM disc QUALIFY row_number() OVER (PARTITION BY question_id, url ORDER BY score DESC, pos) = 1),
firsts AS (SELECT question_id, url, min(pos) AS first_pos FROM disc GROUP BY 1, 2),
qs AS (SELECT question_id, url, string_agg(query, '|' ORDER BY p, query) AS queries FROM (SELECT question_id, url, query, min(pos) AS p FROM disc GROUP BY 1, 2, 3) GROUP BY 1, 2),
grouped AS (SELECT b.*, f.first_pos, q.queries FROM best b JOIN firsts f USING (question_id, url) JOIN qs q USING (question_id, url)),
cands AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY official DESC, score DESC, dated DESC, first_pos) AS candidate_rank FROM grouped)"""


@register("group_candidates", f"WITH {DISC_SQL}, {GROUPED_SQL} SELECT question_id, url, title, score, first_pos AS pos, queries FROM grouped")
def _group_candidates(spark, sf_dir):
    out = group_candidates(scored(spark, sf_dir).drop("question"))
    return out.select("question_id", "url", "title", "score", "pos", joined(F.col("queries")).alias("queries"))


@register("top_candidates", f"WITH {DISC_SQL}, {GROUPED_SQL} SELECT question_id, url, candidate_rank FROM cands WHERE candidate_rank <= 5")
def _top_candidates(spark, sf_dir):
    return top_candidates(group_candidates(scored(spark, sf_dir).drop("question")), 5).select(
        "question_id", "url", "candidate_rank")


@register("discover", f"WITH {DISC_SQL}, {GROUPED_SQL} SELECT question_id, url, score, official, candidate_rank FROM cands WHERE candidate_rank <= 30")
def _discover(spark, sf_dir):
    return discover(plans(spark, sf_dir), web_and_news(spark, sf_dir), dims.authorities(spark), 30).select(
        "question_id", "url", "score", "official", "candidate_rank")


# ---- pages fetched for candidates -----------------------------------------------------------
def landed_pages(spark, sf_dir):
    """Page bodies keyed by canonical URL, the lowest page id of a URL. Some questions find none landed."""
    urls = compute_once(varied_urls(spark, sf_dir), {"url": canonicalize_url(F.col("url"))})
    pages = urls.join(page_bodies(spark, sf_dir).select("page_id", "html"), "page_id")
    return top_k(pages, ["url"], [F.col("page_id").asc()], 1).where(
        F.expr("page_id div 12 % 5 <> 4")).select("url", F.col("url").alias("final_url"), "page_id", "html")


REL_SQL = ROUND.format("""1.0 * len(list_filter(qt, lambda w: contains(ptxt, w))) + 3.0 * len(list_filter(et, lambda w: contains(ptxt, w))) + 2.5 * len(list_filter(gt, lambda w: contains(ptxt, w)))
   + 4 * len(list_filter(entities, lambda e: contains(lower(page_title), lower(e)))) + 3 * len(list_filter(geography, lambda e: contains(lower(page_title), lower(e))))
   + CASE WHEN tier IS NOT NULL THEN 6 ELSE 0 END + least(length(text) / 8000.0, 2.0) + least(discovery_score / 20.0, 2.0)""")


@register("page_score", f"""WITH {VARIED_SQL}, {CANON_SQL}, {AUTH_SQL}, {PLANS_SQL}, {PAGE_TEXT_SQL},
x AS (SELECT page_id, (SELECT arg_min(a.tier, ord) FROM a WHERE c.host = domain OR ends_with(c.host, '.' || domain)) AS tier, p.*, t.text, t.title AS page_title,
   lower(t.title || ' ' || t.text) AS ptxt, CAST(page_id % 60 AS DOUBLE) AS discovery_score FROM canon c JOIN page_text t USING (page_id) JOIN plans p ON p.question_id = page_id // 12)
SELECT page_id, {REL_SQL} AS relevance FROM x""")
def _page_score(spark, sf_dir):
    texts = extract_page_text(page_bodies(spark, sf_dir).select("page_id", "html")).drop("html")
    urls = varied_urls(spark, sf_dir).select("page_id", host(canonicalize_url(F.col("url"))).alias("host"))
    docs = join_authority(texts.join(urls, "page_id"), "host", dims.authorities(spark)).withColumns({
        "question_id": F.expr("page_id div 12"), "discovery_score": F.pmod("page_id", F.lit(60)).cast("double")})
    return score_page(docs.join(with_plan_terms(plans(spark, sf_dir)), "question_id")).select("page_id", "relevance")


@register("page_gate", """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'fetch_failed' WHEN length(text) < 300 THEN 'insufficient_text'
  WHEN doc_id % 10 < 5 THEN 'below_relevance_gate' ELSE 'accepted' END AS gate FROM documents""")
def _page_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.pmod("doc_id", F.lit(10)).cast("double").alias("relevance"),
        F.when(F.pmod("doc_id", F.lit(11)) == 0, "fetch_failed").alias("reject_reason"))
    return page_gate(docs).select("doc_id", F.coalesce("gate_reason", F.lit("accepted")).alias("gate"))


@register("cap_documents", """WITH d AS (SELECT source, doc_id, doc_id % 3 <> 0 AS accepted, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
e AS (SELECT *, coalesce(sum(CASE WHEN accepted THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM d WHERE rn <= 12)
SELECT source, doc_id, accepted FROM e WHERE done < 6""")
def _cap_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", (F.pmod("doc_id", F.lit(3)) != 0).alias("accepted"))
    return cap_documents(docs, key="source", pos="doc_id")


@register("one_per_domain", f"""WITH {VARIED_SQL}, d AS (SELECT page_id % 19 AS question_id, page_id AS pos, regexp_replace(host, '^.*?([^.]*\\.[^.]*)$', '\\1') AS domain, page_id % 5 <> 1 AS ok,
   row_number() OVER (PARTITION BY page_id % 19 ORDER BY page_id) AS rn FROM split),
g AS (SELECT *, row_number() OVER (PARTITION BY question_id, domain ORDER BY pos) AS nth FROM d WHERE rn <= 8 AND ok),
f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS source_no FROM g WHERE nth = 1 OR domain = '')
SELECT question_id, pos, domain, source_no FROM f WHERE source_no <= 4""")
def _one_per_domain(spark, sf_dir):
    name = F.regexp_replace(host(F.trim("url")), r"^.*?([^.]*\.[^.]*)$", "$1")
    docs = varied_urls(spark, sf_dir).select(
        F.pmod("page_id", F.lit(19)).alias("question_id"), F.col("page_id").alias("pos"), name.alias("domain"),
        (F.pmod("page_id", F.lit(5)) != 1).alias("ok"))
    return one_per_domain(docs).select("question_id", "pos", "domain", "source_no")


# ---- model verdicts on documents -------------------------------------------------------------
SCOPES = (" Direct", "partial", "background", "weird", "irrelevant", "direct", "PARTIAL ")
SITES = ("https://www.eia.gov/a", "http://www.eia.gov:80/b", "https://x.org/c", "ftp-no-scheme", "https://www.caiso.com/d")


def judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return accept_validated(docs.select(
        "doc_id", F.concat_ws("-", "source", "lang").alias("question_id"), nth(SITES, i).alias("url"),
        ((F.pmod(i, F.lit(130)) - 10) / 100).alias("relevance_score"), nth(SCOPES, i).alias("source_scope"),
        (F.pmod(i, F.lit(4)) != 0).alias("relevant"), (F.pmod(i, F.lit(3)) != 0).alias("answerable"),
        F.when(F.pmod(i, F.lit(5)) == 0, "controlling").when(F.pmod(i, F.lit(5)) == 4, "primary").otherwise("supporting").alias("source_tier")))


JUDGED_SQL = f"""j0 AS (SELECT doc_id, source || '-' || lang AS question_id, {sql_nth(SITES, 'doc_id')} AS url, greatest(0, least(1, (doc_id % 130 - 10) / 100.0)) AS semantic_score,
   lower(trim({sql_nth(SCOPES, 'doc_id')})) AS s, doc_id % 4 <> 0 AS relevant, doc_id % 3 <> 0 AS ans,
   CASE doc_id % 5 WHEN 0 THEN 'controlling' WHEN 4 THEN 'primary' ELSE 'supporting' END AS source_tier FROM documents),
judged AS (SELECT *, CASE WHEN s = 'weird' THEN 'irrelevant' ELSE s END AS scope, semantic_score >= 0.62 AND s IN ('direct', 'partial') AS accepted FROM j0)"""


@register("accept_validated", f"""WITH {JUDGED_SQL} SELECT doc_id, CAST(semantic_score AS DOUBLE) AS semantic_score, scope, accepted, accepted AND relevant AND ans AS answerable FROM judged""")
def _accept(spark, sf_dir):
    return judged(spark, sf_dir).select("doc_id", "semantic_score", "scope", "accepted", "answerable")


@register("validated_rollup", f"""WITH {JUDGED_SQL}, r AS (SELECT question_id, count(*) FILTER (WHERE accepted) AS accepted_count, count(*) FILTER (WHERE accepted AND scope = 'direct') AS direct_count,
   count(*) FILTER (WHERE accepted AND relevant AND ans) AS answerable_count, count(*) FILTER (WHERE accepted AND source_tier <> 'supporting') AS controlling_count,
   count(DISTINCT CASE WHEN accepted AND contains(url, '://') THEN lower(split_part(url, '/', 3)) END) AS domain_count FROM judged GROUP BY 1)
SELECT *, answerable_count >= 1 AND (direct_count >= 1 OR controlling_count >= 1 OR domain_count >= 2) AS sufficient,
  CASE WHEN answerable_count >= 1 AND (direct_count >= 1 OR controlling_count >= 1 OR domain_count >= 2) THEN 'answerable_evidence'
       WHEN accepted_count = 0 THEN 'all_rejected' ELSE 'not_enough_direct' END AS reason FROM r""")
def _validated_rollup(spark, sf_dir):
    return validated_rollup(judged(spark, sf_dir))


@register("packet_rollup", f"""WITH {JUDGED_SQL}, r AS (SELECT question_id, count(*) AS document_count, count(*) FILTER (WHERE source_tier = 'controlling' AND doc_id % 10 = 0) AS controlling_count,
   count(DISTINCT CASE WHEN contains(url, '://') THEN regexp_replace(regexp_extract(url, '://([^/:]*)', 1), '^www\\.', '') END) AS domain_count FROM judged GROUP BY 1)
SELECT *, controlling_count >= 1 OR domain_count >= 2 AS sufficient,
  CASE WHEN controlling_count >= 1 THEN 'controlling_source' WHEN domain_count >= 2 THEN 'independent_domains' ELSE 'insufficient' END AS reason FROM r""")
def _packet_rollup(spark, sf_dir):
    docs = judged(spark, sf_dir).withColumn("source_tier", F.when(
        F.pmod("doc_id", F.lit(10)) == 0, F.col("source_tier")).otherwise("supporting"))
    return packet_rollup(docs)


NOTES = ("No grid data.", "Old figures.", "", "No grid data.", "Only a press release.", None)


@register("limitations", """SELECT source AS question_id, note AS limitation, min(doc_id) AS first_pos FROM
  (SELECT *, ['No grid data.', 'Old figures.', NULL, 'No grid data.', 'Only a press release.', NULL][(doc_id % 6) + 1] AS note FROM documents) WHERE note IS NOT NULL GROUP BY 1, 2""")
def _limitations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("question_id"), F.col("doc_id").alias("pos"), nth(NOTES, F.col("doc_id")).alias("limitation"))
    return limitations(docs)


# ---- greedy de-duplication ---------------------------------------------------------------------
def packet_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return with_dedup_keys(docs.select(
        F.col("source").alias("packet_id"), i.alias("pos"), "text",
        F.concat(F.lit("https://s.org/p"), F.pmod(i * 7, F.lit(401)).cast("string"), F.when(F.pmod(i, F.lit(2)) == 0, "?a=1").otherwise("")).alias("url"),
        F.when(F.pmod(i, F.lit(29)) == 0, "Home").otherwise("Report").alias("title"), F.lit("direct").alias("scope")))


PACKETS_SQL = f"""docs AS (SELECT source AS packet_id, doc_id AS pos, 'p' || ((doc_id * 7) % 401) AS u, sha256({squeeze_sql('lower(text)')}) AS fp FROM documents WHERE doc_id % 29 <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY packet_id ORDER BY pos) AS n FROM docs),
walk AS (SELECT packet_id, n, pos, true AS keep, [u] AS us, [fp] AS fps FROM numbered WHERE n = 1
  UNION ALL SELECT d.packet_id, d.n, d.pos, NOT (list_contains(w.us, d.u) OR list_contains(w.fps, d.fp)),
    CASE WHEN list_contains(w.us, d.u) OR list_contains(w.fps, d.fp) THEN w.us ELSE w.us || [d.u] END,
    CASE WHEN list_contains(w.us, d.u) OR list_contains(w.fps, d.fp) THEN w.fps ELSE w.fps || [d.fp] END
  FROM walk w JOIN numbered d ON d.packet_id = w.packet_id AND d.n = w.n + 1)"""


@register("greedy_dedup", f"""WITH RECURSIVE {PACKETS_SQL}
SELECT doc_id AS pos, source AS packet_id, coalesce(keep, false) AS retained FROM documents LEFT JOIN walk ON walk.pos = doc_id""")
def _greedy_dedup(spark, sf_dir):
    return greedy_dedup(packet_docs(spark, sf_dir)).select("packet_id", "pos", "retained")


@register("dedup_capped", f"""WITH RECURSIVE docs AS (SELECT doc_id // 6 AS packet_id, doc_id AS pos, 'p' || ((doc_id * 7) % 5) AS u, sha256({squeeze_sql('lower(text)')}) AS fp FROM documents WHERE doc_id % 29 <> 0),
{"numbered AS" + PACKETS_SQL.split("numbered AS", 1)[1]}
SELECT doc_id AS pos, coalesce(keep, false) AS retained FROM documents LEFT JOIN walk ON walk.pos = doc_id""")
def _dedup_capped(spark, sf_dir):
    docs = packet_docs(spark, sf_dir).withColumns({
        "packet_id": F.expr("pos div 6"), "dedup_url": F.concat(F.lit("p"), F.pmod(F.col("pos") * 7, F.lit(5)).cast("string"))})
    return dedup_capped(docs, key="packet_id").select("pos", "retained")


@register("retained_rollup", f"""WITH RECURSIVE {PACKETS_SQL}
SELECT source AS packet_id, count(*) FILTER (WHERE keep) AS retained_count, count(*) FILTER (WHERE keep) > 0 AS sufficient,
  CASE WHEN count(*) FILTER (WHERE keep) > 0 THEN 'unique_evidence' ELSE 'only_duplicates_or_generic' END AS reason
FROM documents LEFT JOIN walk ON walk.pos = doc_id GROUP BY 1""")
def _retained_rollup(spark, sf_dir):
    return retained_rollup(greedy_dedup(packet_docs(spark, sf_dir)), "packet_id")


# ---- whole chain ---------------------------------------------------------------------------------
def verdicts(spark, sf_dir):
    """The model's verdict on landed pages for the question they were found for; one in five is missing."""
    urls = landed_pages(spark, sf_dir).where("page_id % 5 <> 2")
    i = F.col("page_id")
    return urls.select(
        F.expr("page_id div 12").alias("question_id"), "url", (F.pmod(i, F.lit(100)) / 100 + 0.3).alias("relevance_score"),
        (F.pmod(i, F.lit(4)) != 0).alias("relevant"), (F.pmod(i, F.lit(3)) != 0).alias("answerable"),
        nth(("direct", "partial", "background"), i).alias("source_scope"))


BATCH_SQL = f"""{DISC_SQL}, {GROUPED_SQL}, {PAGE_TEXT_SQL},
landed AS (SELECT canonical AS url, min(page_id) AS page_id FROM canon GROUP BY 1 HAVING min(page_id) // 12 % 5 <> 4),
tried AS (SELECT c.question_id, c.candidate_rank AS pos, c.url, c.score AS discovery_score, c.title AS result_title, c.host, CASE WHEN l.page_id IS NOT NULL THEN t.tier END AS tier, c.qt, c.et, c.gt, c.entities, c.geography,
    l.page_id, x.title AS page_title, x.text, lower(x.title || ' ' || x.text) AS ptxt
  FROM cands c LEFT JOIN landed l USING (url) LEFT JOIN page_text x ON x.page_id = l.page_id LEFT JOIN tiers t ON t.host = c.host WHERE candidate_rank <= 12),
rel AS (SELECT *, {REL_SQL} AS relevance FROM tried),
gated AS (SELECT *, CASE WHEN page_id IS NULL THEN 'not_fetched' WHEN length(text) < 80 THEN 'insufficient_text' WHEN length(text) < 300 THEN 'insufficient_text'
    WHEN relevance < 5 THEN 'below_relevance_gate' END AS gate_reason FROM rel),
capped AS (SELECT *, coalesce(sum(CASE WHEN gate_reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM gated),
documents_out AS (SELECT * FROM capped WHERE done < 6),
verdict AS (SELECT page_id // 12 AS question_id, url, (page_id % 100) / 100.0 + 0.3 AS rs, page_id % 4 <> 0 AS relevant, page_id % 3 <> 0 AS ans, ['direct', 'partial', 'background'][(page_id % 3) + 1] AS scope FROM landed WHERE page_id % 5 <> 2),
jd AS (SELECT d.*, v.rs IS NULL AS failed, v.scope, coalesce(least(1.0, v.rs) >= 0.62 AND v.rs IS NOT NULL AND v.scope IN ('direct', 'partial'), false) AS accepted, v.relevant, v.ans FROM documents_out d LEFT JOIN verdict v USING (question_id, url) WHERE gate_reason IS NULL)"""


@register("collect_evidence", f"WITH {BATCH_SQL} SELECT question_id, pos, url, coalesce(gate_reason, 'accepted') AS gate, coalesce(relevance, -1) AS relevance FROM documents_out")
def _collect(spark, sf_dir):
    cands = discover(plans(spark, sf_dir), web_and_news(spark, sf_dir), dims.authorities(spark), 30)
    out = collect(cands, plans(spark, sf_dir), landed_pages(spark, sf_dir), dims.authorities(spark), tried=12, accepted=6)
    return out.select("question_id", "pos", "url", F.coalesce("gate_reason", F.lit("accepted")).alias("gate"),
                      F.coalesce("relevance", F.lit(-1.0)).alias("relevance"))


PACKET_SQL = f"""{BATCH_SQL},
ok AS (SELECT question_id, pos, regexp_replace(url, '\\?.*$', '') AS u, sha256({squeeze_sql('lower(text)')}) AS fp FROM jd
   WHERE accepted AND NOT (lower(trim(page_title)) IN ('homepage', 'home', 'welcome', 'what''s new') OR (regexp_extract(url, '://[^/?#]*/*([^?#]*)', 1) = '' AND scope <> 'direct'))),
numbered AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS n FROM ok),
walk AS (SELECT question_id, n, pos, true AS keep, [u] AS us, [fp] AS fps FROM numbered WHERE n = 1
  UNION ALL SELECT d.question_id, d.n, d.pos, NOT (list_contains(w.us, d.u) OR list_contains(w.fps, d.fp)),
    CASE WHEN list_contains(w.us, d.u) OR list_contains(w.fps, d.fp) THEN w.us ELSE w.us || [d.u] END,
    CASE WHEN list_contains(w.us, d.u) OR list_contains(w.fps, d.fp) THEN w.fps ELSE w.fps || [d.fp] END
  FROM walk w JOIN numbered d ON d.question_id = w.question_id AND d.n = w.n + 1),
kept AS (SELECT question_id, count(*) AS retained_count FROM walk WHERE keep GROUP BY 1),
rolled AS (SELECT question_id, count(*) FILTER (WHERE accepted) AS accepted_count, count(*) FILTER (WHERE accepted AND scope = 'direct') AS direct_count,
   count(*) FILTER (WHERE accepted AND relevant AND ans) AS answerable_count, count(*) FILTER (WHERE failed) AS failed_count FROM jd GROUP BY 1)"""


@register("evidence_batch", f"""WITH RECURSIVE {PACKET_SQL}
SELECT question_id, coalesce(accepted_count, 0) AS accepted_count, coalesce(direct_count, 0) AS direct_count, coalesce(answerable_count, 0) AS answerable_count,
  coalesce(failed_count, 0) AS failed_count, coalesce(retained_count, 0) AS retained_count, coalesce(retained_count, 0) > 0 AS sufficient,
  CASE WHEN retained_count > 0 THEN 'unique_evidence' WHEN accepted_count > 0 THEN 'only_duplicates_or_generic' WHEN accepted_count = 0 THEN 'all_rejected'
       ELSE 'no_evidence' END AS reason FROM plans LEFT JOIN rolled USING (question_id) LEFT JOIN kept USING (question_id)""")
def _evidence_batch(spark, sf_dir):
    tables = evidence_batch(plans(spark, sf_dir), web_and_news(spark, sf_dir), landed_pages(spark, sf_dir),
                            verdicts(spark, sf_dir), dims.authorities(spark), k=30, tried=12, accepted_pages=6)
    return packet_status(tables).select("question_id", "accepted_count", "direct_count", "answerable_count",
                                        "failed_count", "retained_count", "sufficient", "reason")


# ---- cited answers: the model's drafts and claims are made from the plans ------------------------
def syntheses(spark, sf_dir):
    """Drafts of three in four questions, three claims each; some cite sources that are not there."""
    asked = plans(spark, sf_dir).select("question_id", "question").where("question_id % 4 <> 3")
    drafts = asked.select(
        "question_id", F.concat(F.lit(" About "), "question").alias("direct_answer"), F.concat(F.lit("Because "), "question").alias("explanation"),
        nth((" HIGH", "sure"), F.col("question_id")).alias("confidence"), F.array(F.lit(" note "), F.lit(""), F.lit("note")).alias("limitations"))
    ids = lambda *values: F.array(*(F.lit(v) for v in values))
    made = F.array(*(F.struct(F.lit(kind).alias("claim_type"), cited.alias("source_ids"), F.lit(text).alias("text")) for kind, cited, text in (
        ("fact", ids(1, 1, 99), " one "), ("FACT", ids(50), "two"), ("opinion", ids(0, 2, 1), "three"))))
    return drafts, asked.select("question_id", F.explode(made).alias("c")).select("question_id", "c.*")


CITED_SQL = f"""{PACKET_SQL},
rejected AS (SELECT question_id, count(*) FILTER (WHERE NOT accepted AND NOT failed) AS rejected_count FROM jd GROUP BY 1),
st AS (SELECT question_id, question_id % 4 <> 3 AND coalesce(retained_count, 0) > 0 AS answered, coalesce(retained_count, 0) AS retained, coalesce(rejected_count, 0) AS rejected, coalesce(failed_count, 0) AS failed,
  CASE WHEN retained_count > 0 THEN 'no_model_answer' WHEN accepted_count > 0 THEN 'only_duplicates_or_generic' WHEN accepted_count = 0 THEN 'all_rejected' ELSE 'no_evidence' END AS reason
  FROM plans LEFT JOIN rolled USING (question_id) LEFT JOIN kept USING (question_id) LEFT JOIN rejected USING (question_id))"""


def _cited(spark, sf_dir):
    tables = evidence_batch(plans(spark, sf_dir), web_and_news(spark, sf_dir), landed_pages(spark, sf_dir),
                            verdicts(spark, sf_dir), dims.authorities(spark), k=30, tried=12, accepted_pages=6)
    return cited_answers(plans(spark, sf_dir), tables, *syntheses(spark, sf_dir))


@register("cited_answers", f"""WITH RECURSIVE {CITED_SQL}
SELECT question_id, CASE WHEN answered THEN 'answered' ELSE 'held' END AS status, CASE WHEN NOT answered THEN 'insufficient' WHEN question_id % 2 = 0 THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN answered THEN trim('About ' || question) ELSE 'The available verified evidence is not sufficient to provide a reliable answer.' END AS direct_answer,
  CASE WHEN answered THEN 'note' WHEN failed > 0 THEN reason || '|' || failed || ' validations failed' ELSE reason END AS limitations,
  retained AS accepted_documents, rejected AS rejected_documents, failed AS validation_failures, true AS passed FROM st JOIN plans USING (question_id)""")
def _cited_answers(spark, sf_dir):
    return _cited(spark, sf_dir).answers.select(
        "question_id", "status", "confidence", "direct_answer", joined(F.col("limitations")).alias("limitations"),
        "accepted_documents", "rejected_documents", "validation_failures", "passed")


@register("cited_sources", f"""WITH RECURSIVE {CITED_SQL}
SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY w.pos) AS INTEGER) AS source_id, url, coalesce(nullif(page_title, ''), result_title) AS title
FROM walk w JOIN jd USING (question_id, pos) JOIN st USING (question_id) WHERE w.keep AND answered""")
def _cited_sources(spark, sf_dir):
    return _cited(spark, sf_dir).sources.select("question_id", "source_id", "url", "title")


@register("cited_claims", f"""WITH RECURSIVE {CITED_SQL}
SELECT question_id, 'one' AS text, 'fact' AS claim_type, '1' AS source_ids FROM st WHERE answered
UNION ALL SELECT question_id, 'three', 'context', CASE WHEN retained > 1 THEN '2,1' ELSE '1' END FROM st WHERE answered""")
def _cited_claims(spark, sf_dir):
    return _cited(spark, sf_dir).claims.select("question_id", "text", "claim_type", joined(F.col("source_ids"), ",").alias("source_ids"))


@register("citation_release", f"""WITH {JUDGED_SQL}, r AS (SELECT question_id, count(*) FILTER (WHERE accepted) AS n FROM judged GROUP BY 1)
SELECT question_id, CASE WHEN n < 3 THEN 'held' ELSE 'answered' END AS status, CASE WHEN n < 3 THEN 'insufficient' WHEN n % 3 = 0 THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN n < 3 THEN 'The available verified evidence is not sufficient to provide a reliable answer.' ELSE 'Answer ' || question_id END AS direct_answer,
  CASE WHEN n < 3 THEN 'too_few|failed ' || n ELSE 'note' END AS limitations FROM r""")
def _citation_release(spark, sf_dir):
    packets = judged(spark, sf_dir).groupBy("question_id").agg(F.count_if("accepted").alias("document_count"))
    n = F.col("document_count")
    packets = packets.withColumns({
        "sufficient": n >= 3, "reason": F.lit("too_few"), "direct_answer": F.concat(F.lit(" Answer "), "question_id"),
        "failures": F.array(F.concat(F.lit("failed "), n.cast("string")), F.lit("too_few")),
        "notes": F.array(F.lit("note")), "model_confidence": F.when(n % 3 == 0, " HIGH").otherwise("sure")})
    return citation_release(packets).select("question_id", "status", "confidence", "direct_answer",
                                            joined(F.col("limitations")).alias("limitations"))
