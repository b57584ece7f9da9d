"""Text, URL and page expressions on ``documents``, ``pages`` and ``conversations``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger import dims
from gridledger.functions import fixed_values as fv
from gridledger.functions.plan import compute_once
from gridledger.functions.text import (
    answer_terms, content_fingerprint, display_name, extract_entities, extract_nodes,
    freshness_need, norm_text, normalize_route, power_full, power_online, tokenize)
from gridledger.functions.times import report_date
from gridledger.functions.urls import approved, canonicalize_url, dedup_url, host
from gridledger.operators.evidence import (
    drop_low_value, is_generic_homepage, score_source)
from gridledger.operators.joins import join_authority, join_provider, match_word_terms
from gridledger.operators.ranking import first_seen, limit_page, rank_results
from gridledger.queries.base import (
    PHRASES, QUESTIONS_SQL, joined, norm_sql, nth, questions, register, rules_cte, sql_list,
    sql_nth, sql_rows, sql_text, squeeze_sql, table)
from gridledger.sources.web import BREAKS, HIDDEN, extract_page_blocks, extract_page_text


@register("norm_text", f"SELECT doc_id, md5({norm_sql('text')}) AS normalized FROM documents")
def _norm_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(norm_text(F.col("text"))).alias("normalized"))


@register("tokenize", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(
  regexp_extract_all(lower(text), '[a-z0-9][a-z0-9&.-]+'), lambda w: length(w) >= 3 AND NOT list_contains({sql_list(fv.SEARCH_STOPWORDS)}, w)))), ' ') AS terms
FROM documents""")
def _tokenize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", joined(F.array_sort(tokenize(F.col("text"))), " ").alias("terms"))


def answer_terms_sql(column: str) -> str:
    """List of aligned answer terms."""
    tokens = f"regexp_extract_all(replace(lower({column}), '-', ' '), '[a-z0-9][a-z0-9&.]+')"
    bare = f"list_transform({tokens}, lambda w: replace(trim(w, '._-'), '&', 'and'))"
    aligned = (f"list_transform({bare}, lambda w: CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, length(w) - 3) || 'y'"
               " WHEN length(w) > 4 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END)")
    return (f"list_distinct(list_filter({aligned}, lambda w: length(w) >= 3"
            f" AND NOT list_contains({sql_list(fv.ANSWER_STOPWORDS)}, w)))")


@register("answer_terms", f"SELECT doc_id, array_to_string(list_sort({answer_terms_sql('text')}), ' ') AS terms FROM documents")
def _answer_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", joined(F.array_sort(answer_terms(F.col("text"))), " ").alias("terms"))


@register("content_fingerprint", f"SELECT doc_id, sha256({squeeze_sql('lower(text)')}) AS fingerprint FROM documents")
def _content_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content_fingerprint(F.col("text")).alias("fingerprint"))


@register("first_seen_document", f"""SELECT sha256({squeeze_sql('lower(text)')}) AS fingerprint, min(doc_id) AS doc_id,
  arg_min(source, doc_id) AS source FROM documents GROUP BY 1""")
def _first_seen(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        content_fingerprint(F.col("text")).alias("fingerprint"), "doc_id", "source")
    return first_seen(docs, ["fingerprint"], "doc_id")


ENTITY_CASE = ", ".join(
    f"CASE WHEN regexp_matches(question, '(?i)\\b{p}\\b') THEN '{name}' END" for p, name in fv.ENTITY_MENTIONS)


@register("extract_entities", f"""WITH {QUESTIONS_SQL} SELECT question_id, concat_ws('|', {ENTITY_CASE}) AS entities FROM questions""")
def _extract_entities(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", joined(extract_entities(F.col("question"))).alias("entities"))


@register("extract_nodes", f"""WITH {QUESTIONS_SQL} SELECT question_id, array_to_string(list_sort(list_distinct(list_transform(
  regexp_extract_all(question, '{fv.NODE_PATTERN}'), lambda m: replace(replace(upper(m), 'NP15', 'NP-15'), 'SP15', 'SP-15')))), '|') AS nodes FROM questions""")
def _extract_nodes(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", joined(F.array_sort(extract_nodes(F.col("question")))).alias("nodes"))


def _any_sql(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


FRESH_SQL = f"""CASE WHEN {_any_sql('n', fv.LIVE_TERMS)} THEN 'live' WHEN {_any_sql('n', fv.CURRENT_TERMS)} THEN 'current'
  WHEN regexp_matches(n, '\\b(19|20)\\d{{2}}\\b') THEN 'historical' ELSE 'stable' END"""


@register("freshness_need", f"""WITH {QUESTIONS_SQL}, t AS (SELECT question_id, {norm_sql('question')} AS n FROM questions)
SELECT question_id, {FRESH_SQL} AS freshness FROM t""")
def _freshness(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", freshness_need(F.col("question")).alias("freshness"))


# ---- URLs -------------------------------------------------------------------------
HOSTS = ("eia.gov", "oasis.caiso.com", "example.com", "energy.ca.gov", "reuters.com", "notferc.gov", "sec.gov",
         "data.ca.gov", "api.eia.gov", "woodmac.com", "Elibrary.FERC.gov", "nrc.gov", "sdge.com", "stanford.edu")
TAILS = ("", "?utm_medium=x&Q=a%20b&ref=1&z=%C3%A9&empty=", ":443", "&gclid=1&b=c+d~e", "?source=feed&&a=1=2")


def varied_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs with energy hosts, ports, doubled slashes, capitals and parameters."""
    pages = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    url = F.regexp_replace("url", r"example\.(com|net|org)", nth(HOSTS, i))
    url = F.when(F.pmod(i, F.lit(5)) == 2, F.regexp_replace(url, "^(https?://[^/]+)/", "$1:443/")).otherwise(
        F.concat(url, nth(TAILS, i)))
    url = F.when(F.pmod(i, F.lit(3)) == 1, F.regexp_replace(url, r"/(en|fr|de|es)/", "//$1//")).otherwise(url)
    url = F.when(F.pmod(i, F.lit(4)) == 3, F.regexp_replace(url, "^http", "HTTP")).otherwise(url)
    url = F.when(F.pmod(i, F.lit(17)) == 8, F.concat(F.lit("  "), url, F.lit(" "))).otherwise(url)
    url = F.when(F.pmod(i, F.lit(31)) == 9, F.lit("no scheme/path")).otherwise(url)
    return compute_once(pages.select("page_id", "url"), {"url": url})


VARIED_SQL = f"""v0 AS (SELECT page_id, regexp_replace(url, 'example\\.(com|net|org)', {sql_nth(HOSTS, 'page_id')}) AS u FROM pages),
v1 AS (SELECT page_id, CASE WHEN page_id % 5 = 2 THEN regexp_replace(u, '^(https?://[^/]+)/', '\\1:443/') ELSE u || {sql_nth(TAILS, 'page_id')} END AS u FROM v0),
v2 AS (SELECT page_id, CASE WHEN page_id % 3 = 1 THEN regexp_replace(u, '/(en|fr|de|es)/', '//\\1//') ELSE u END AS u FROM v1),
v3 AS (SELECT page_id, CASE WHEN page_id % 4 = 3 THEN regexp_replace(u, '^http', 'HTTP') ELSE u END AS u FROM v2),
v4 AS (SELECT page_id, CASE WHEN page_id % 17 = 8 THEN '  ' || u || ' ' ELSE u END AS u FROM v3),
urls AS (SELECT page_id, CASE WHEN page_id % 31 = 9 THEN 'no scheme/path' ELSE u END AS url FROM v4),
parts AS (SELECT page_id, trim(url) AS url, lower(regexp_extract(trim(url), '^([A-Za-z]+)://', 1)) AS scheme,
   lower(regexp_extract(trim(url), '://([^/?#]*)', 1)) AS site, regexp_extract(trim(url), '://[^/?#]*([^?#]*)', 1) AS path,
   regexp_extract(trim(url), '^[^?#]*\\?([^#]*)', 1) AS query FROM urls),
split AS (SELECT *, regexp_replace(split_part(site, ':', 1), '^www\\.', '') AS host, split_part(site, ':', 2) AS port,
   CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '/+', '/', 'g') END AS clean_path FROM parts),
normal AS (SELECT *, host || CASE WHEN port = '' OR (scheme = 'https' AND port = '443') OR (scheme = 'http' AND port = '80') THEN '' ELSE ':' || port END AS net,
   list_filter(list_transform(list_filter(string_split(query, '&'), lambda p: p <> ''),
     lambda p: {{'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'v': url_decode(replace(CASE WHEN contains(p, '=') THEN substr(p, strpos(p, '=') + 1) ELSE '' END, '+', ' '))}}),
     lambda e: NOT list_contains({sql_list(fv.TRACKING_PARAMETERS)}, lower(e.k)) AND NOT starts_with(lower(e.k), 'utm_')) AS pairs FROM split)"""
ENC = "replace(url_encode({0}), '%20', '+')"


@register("canonicalize_url", f"""WITH {VARIED_SQL}
SELECT page_id, CASE WHEN scheme = '' OR host = '' THEN url ELSE scheme || '://' || net
   || CASE WHEN clean_path = '/' THEN '/' ELSE rtrim(clean_path, '/') END
   || CASE WHEN len(pairs) = 0 THEN '' ELSE '?' || array_to_string(list_transform(pairs, lambda e: {ENC.format('e.k')} || '=' || {ENC.format('e.v')}), '&') END END AS canonical FROM normal""")
def _canonicalize_url(spark, sf_dir):
    return varied_urls(spark, sf_dir).select("page_id", canonicalize_url(F.col("url")).alias("canonical"))


@register("dedup_url", f"""WITH {VARIED_SQL}
SELECT n.page_id, CASE WHEN regexp_matches(u.url, '^ ') THEN regexp_replace(regexp_replace(u.url, '[?#].*$', ''), '/+', '/', 'g')
  WHEN scheme = '' THEN n.url ELSE scheme || '://' || net || clean_path END AS identity FROM normal n JOIN urls u USING (page_id)""")
def _dedup_url(spark, sf_dir):
    return varied_urls(spark, sf_dir).select("page_id", dedup_url(F.col("url")).alias("identity"))


@register("host", f"WITH {VARIED_SQL} SELECT page_id, host FROM split")
def _host(spark, sf_dir):
    return varied_urls(spark, sf_dir).select("page_id", host(F.trim("url")).alias("host"))


@register("filter_approved_hosts", f"""WITH {VARIED_SQL} SELECT page_id, host FROM split
WHERE scheme = 'https' AND (host IN ('eia.gov', 'caiso.com') OR host LIKE '%.eia.gov' OR host LIKE '%.caiso.com')""")
def _filter_approved(spark, sf_dir):
    urls = varied_urls(spark, sf_dir).withColumn("url", F.trim("url"))
    return urls.where(approved(F.col("url"), ("eia.gov", "caiso.com"))).select("page_id", host(F.col("url")).alias("host"))


AUTH_SQL = "a(domain, ord, tier, organization) AS (VALUES " + sql_rows(
    [(d, i, t, o) for i, (d, t, o) in enumerate(dims.AUTHORITIES)]) + ")"


@register("join_authority", f"""WITH {VARIED_SQL}, {AUTH_SQL}
SELECT page_id, host, arg_min(tier, ord) AS tier, arg_min(organization, ord) AS organization
FROM split LEFT JOIN a ON host = domain OR ends_with(host, '.' || domain) GROUP BY page_id, host""")
def _join_authority(spark, sf_dir):
    urls = varied_urls(spark, sf_dir).select("page_id", host(F.trim("url")).alias("host"))
    return join_authority(urls, "host", dims.authorities(spark))


PROVIDER_DOMAIN_SQL = "p(provider_id, provider_name, authority_rank, domain) AS (VALUES " + sql_rows(
    [(r[0], r[1], r[2], d) for r in dims.provider_rows() for d in r[5]]) + ")"


@register("join_provider", f"""WITH {VARIED_SQL}, {PROVIDER_DOMAIN_SQL}
SELECT page_id, arg_min(provider_id, (authority_rank, provider_name)) AS provider_id
FROM split LEFT JOIN p ON host = domain OR ends_with(host, '.' || domain) GROUP BY page_id""")
def _join_provider(spark, sf_dir):
    urls = varied_urls(spark, sf_dir).select("page_id", host(F.trim("url")).alias("host"))
    return join_provider(urls, "host", dims.providers(spark)).select("page_id", "provider_id")


@register("match_word_terms", f"""WITH {QUESTIONS_SQL}, {rules_cte('vocab', fv.DOMAIN_TERMS)},
t AS (SELECT question_id, ' ' || {norm_sql('question')} || ' ' AS n FROM questions),
w AS (SELECT DISTINCT label, {norm_sql('term')} AS term FROM vocab)
SELECT question_id, label, term FROM t JOIN w ON contains(n, ' ' || term || ' ')""")
def _match_word_terms(spark, sf_dir):
    rows = [(label, term) for label, terms in fv.DOMAIN_TERMS for term in terms]
    vocab = dims.small_table(spark, rows, [("label", dims._S), ("term", dims._S)])
    return match_word_terms(questions(spark, sf_dir), vocab, "question_id", "question")


@register("match_terms", f"""WITH {QUESTIONS_SQL}, {rules_cte('vocab', fv.TOPIC_TERMS)}
SELECT question_id, label, count(*) AS hits FROM questions JOIN vocab ON contains(lower(question), term) GROUP BY 1, 2""")
def _match_terms(spark, sf_dir):
    from gridledger.functions.text import contains_count

    q = compute_once(questions(spark, sf_dir), {"low": F.lower("question")})
    counts = F.array(*[F.struct(F.lit(label).alias("label"), contains_count(F.col("low"), terms).alias("hits"))
                       for label, terms in fv.TOPIC_TERMS])
    flat = q.select("question_id", F.inline(counts))
    return flat.where("hits > 0")


# ---- search results derived from pages --------------------------------------------
def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search result per page: title phrase, snippet, URL and domain."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.length("html").alias("n"))
    urls = varied_urls(spark, sf_dir).withColumn("url", F.trim("url"))
    out = urls.join(pages, "page_id")
    return out.select(
        F.expr("page_id div 12").alias("question_id"), F.col("page_id").alias("pos"),
        nth(PHRASES, F.col("page_id") * 3).alias("title"), nth(PHRASES, F.col("page_id") + 5).alias("snippet"),
        "url", F.lit("").alias("domain"), nth(PHRASES, F.expr("page_id div 12")).alias("question"))


RESULTS_SQL = f"""results AS (SELECT page_id // 12 AS question_id, page_id AS pos, {sql_nth(PHRASES, 'page_id * 3')} AS title,
   {sql_nth(PHRASES, 'page_id + 5')} AS snippet, url, host, {sql_nth(PHRASES, 'page_id // 12')} AS question FROM split)"""
TIER_SQL = """CASE WHEN list_has_any({c}, [host]) OR {cs} THEN 'controlling' WHEN list_has_any({a}, [host]) OR {as_} THEN 'authoritative'
  WHEN host <> '' THEN 'supporting' ELSE 'unknown' END""".format(
    c=sql_list(fv.CONTROLLING_DOMAINS), cs="(" + " OR ".join(f"ends_with(host, '.{d}')" for d in fv.CONTROLLING_DOMAINS) + ")",
    a=sql_list(fv.AUTHORITATIVE_DOMAINS), as_="(" + " OR ".join(f"ends_with(host, '.{d}')" for d in fv.AUTHORITATIVE_DOMAINS) + ")")
SOURCE_SCORE_SQL = f"""scored AS (SELECT *, {TIER_SQL} AS source_tier, lower(title || ' ' || snippet || ' ' || host) AS txt,
   list_distinct(list_filter(list_transform(string_split_regex(trim(question), '\\s+'), lambda w: lower(trim(w, '.,?!:;()[]{{}}'))), lambda w: length(w) >= 3)) AS terms FROM results),
ranked AS (SELECT *, CASE source_tier WHEN 'controlling' THEN 50.0 WHEN 'authoritative' THEN 30.0 WHEN 'supporting' THEN 10.0 ELSE 0.0 END
   + 4.0 * len(list_filter(terms, lambda w: contains(txt, w))) + 1.5 * len(list_filter({sql_list(fv.ENERGY_TERMS)}, lambda w: contains(txt, w))) AS score FROM scored)"""


@register("source_score", f"""WITH {VARIED_SQL}, {RESULTS_SQL}, {SOURCE_SCORE_SQL}
SELECT question_id, pos, source_tier, CAST(score AS DOUBLE) AS score FROM ranked""")
def _source_score(spark, sf_dir):
    return score_source(results(spark, sf_dir)).select("question_id", "pos", "source_tier", "score")


@register("rank_results", f"""WITH {VARIED_SQL}, {RESULTS_SQL}, {SOURCE_SCORE_SQL}
SELECT question_id, pos, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, pos) AS result_rank FROM ranked""")
def _rank_results(spark, sf_dir):
    return rank_results(score_source(results(spark, sf_dir)), chunk_size=50).select("question_id", "pos", "result_rank")


@register("drop_low_value", f"""WITH {VARIED_SQL}, {RESULTS_SQL}
SELECT question_id, pos, title FROM results WHERE NOT regexp_matches(lower(title || ' ' || snippet || ' ' || url), '{fv.LOW_VALUE_PATTERN}')""")
def _drop_low_value(spark, sf_dir):
    return drop_low_value(results(spark, sf_dir)).select("question_id", "pos", "title")


TITLES = (" Home ", "WELCOME", "Load report", "what's new", "Homepage", "Prices", "")


@register("is_generic_homepage", f"""WITH {VARIED_SQL}
SELECT page_id, lower(trim({sql_nth(TITLES, 'page_id')})) IN ('homepage', 'home', 'welcome', 'what''s new')
  OR (CASE WHEN page_id % 6 = 1 THEN '' ELSE trim(path, '/') END = '' AND page_id % 2 = 1) AS generic FROM split""")
def _generic(spark, sf_dir):
    urls = varied_urls(spark, sf_dir).withColumn("url", F.trim("url"))
    i = F.col("page_id")
    url = F.when(F.pmod(i, F.lit(6)) == 1, F.regexp_replace("url", r"(://[^/?#]*)[^?#]*", "$1/")).otherwise(F.col("url"))
    return urls.select("page_id", is_generic_homepage(
        nth(TITLES, i), url, F.when(F.pmod(i, F.lit(2)) == 1, "partial").otherwise("direct")).alias("generic"))


# ---- page text -----------------------------------------------------------------------
# Character references that occur in the pages and in what ``page_bodies`` adds.
REFERENCES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&reg;", "®"),
    ("&deg;", "°"), ("&middot;", "·"), ("&bull;", "•"), ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&hellip;", "…"),
    ("&eacute;", "é"), ("&euro;", "€"), ("&times;", "×"), ("&#x27;", "'"), ("&#X2014;", "—"), ("&#233;", "é"),
)
ADDED = "<p>caf&eacute; &#x27;q&#x27; &euro;5 &times; &nosuch; &#233;&#X2014; &#x110000; a&amp;lt;b</p>"
UNCLOSED = "<div>last</div><script>var hidden = \"<p>never shown</p>\";"
# Nested, crossed and stray hidden tags, a script that names one, and what of it is seen.
NESTED = ("</svg><p>a<svg><g>x</g><svg>y</svg>z</svg>b</p><template>t<noscript>n</template>m</noscript>c<canvas/>d"
          "<svg><title>no</title><script>if (a</svg>b) x</script>e</svg>f<!-- <template> -->g")
NESTED_SEEN = "<p>a b</p> c d f g"
BODIES_SQL = f"""(SELECT page_id, html || CASE WHEN page_id % 3 = 0 THEN {sql_text(ADDED)} ELSE '' END || CASE WHEN page_id % 7 = 0 THEN {sql_text(NESTED_SEEN)} ELSE '' END
  || CASE WHEN page_id % 5 = 0 THEN {sql_text(UNCLOSED)} ELSE '' END AS html FROM pages)"""


def page_bodies(spark, sf_dir, nested=NESTED):
    """Pages, some with more character references, some with hidden tags in disorder, some with a script that never ends."""
    add = lambda n, text: F.when(F.col("page_id") % n == 0, text).otherwise("")
    return table(spark, sf_dir, "pages").withColumn("html", F.concat("html", add(3, ADDED), add(7, nested), add(5, UNCLOSED)))


def decode_sql(expr: str) -> str:
    for name, char in REFERENCES:
        expr = f"replace({expr}, {sql_text(name)}, {sql_text(char)})"
    return f"replace({expr}, '&amp;', '&')"


_SP = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
PAGE_TEXT_SQL = f"""t0 AS (SELECT page_id, regexp_replace(html, '{HIDDEN.replace("(?is)", "")}', ' ', 'gis') AS h,
    {squeeze_sql(decode_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} AS title FROM {BODIES_SQL}),
t1 AS (SELECT page_id, title, regexp_replace(h, '{BREAKS.replace("(?i)", "")}', chr(10), 'gi') AS h FROM t0),
t2 AS (SELECT page_id, title, {decode_sql("regexp_replace(h, '<[^>]*>', ' ', 'g')")} AS h FROM t1),
t3 AS (SELECT page_id, title, regexp_replace(h, '{_SP}*\\n{_SP}*', chr(10), 'g') AS h FROM (SELECT page_id, title, regexp_replace(h, '[ \\t]+', ' ', 'g') AS h FROM t2)),
page_text AS (SELECT page_id, title, regexp_replace(h, '^{_SP}+|{_SP}+$', '', 'g') AS text FROM t3)"""


@register("extract_page_text", f"""WITH {PAGE_TEXT_SQL}
SELECT page_id, title, md5(text) AS text_hash, length(text) AS n_chars,
  CASE WHEN length(text) < 80 THEN 'insufficient_text' ELSE 'ok' END AS state FROM page_text""")
def _extract_page_text(spark, sf_dir):
    out = extract_page_text(page_bodies(spark, sf_dir))
    return out.select("page_id", "title", F.md5("text").alias("text_hash"), F.length("text").alias("n_chars"),
                      F.coalesce("reject_reason", F.lit("ok")).alias("state"))


@register("extract_page_blocks", f"""WITH t0 AS (SELECT page_id, regexp_replace(html, '{HIDDEN.replace("(?is)", "")}', '', 'gis') AS h FROM {BODIES_SQL}),
pieces AS (SELECT page_id, generate_subscripts(regexp_extract_all(h, '(?s)<[^>]*>[^<]*'), 1) AS pos, unnest(regexp_extract_all(h, '(?s)<[^>]*>[^<]*')) AS p FROM t0),
chunks AS (SELECT page_id, pos, regexp_matches(p, '(?is)^<({'|'.join(fv.BLOCK_TEXT_TAGS)})\\b[^>]*>') AS listed,
   {squeeze_sql(decode_sql("regexp_replace(p, '(?s)^<[^>]*>', '')"))} AS t FROM pieces)
SELECT page_id, md5(coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (WHERE t <> '' AND (listed OR length(t) >= 40)), '')) AS text_hash FROM chunks GROUP BY 1""")
def _extract_page_blocks(spark, sf_dir):
    return extract_page_blocks(page_bodies(spark, sf_dir, NESTED_SEEN)).select("page_id", F.md5("text").alias("text_hash"))


# ---- small scalar expressions -----------------------------------------------------------
REPORT_MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
                 "November", "December", "Foo", "Jan")


@register("report_date", f"""WITH o AS (SELECT o_orderkey, {sql_list(REPORT_MONTHS)}[(o_orderkey % 14) + 1] AS mon, o_orderkey % 14 + 1 AS m, 1 + (o_custkey % 31) AS d FROM orders)
SELECT o_orderkey, CASE WHEN m <= 12 AND d <= extract(day FROM last_day(make_date(2024, m, 1))) THEN CAST(make_date(2024, m, d) AS VARCHAR) END AS report_date
FROM (SELECT o_orderkey, CASE WHEN m > 12 THEN 13 ELSE m END AS m, d FROM o) WHERE m <= 12
UNION ALL SELECT o_orderkey, NULL FROM o WHERE m > 12""")
def _report_date(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    title = F.concat(F.lit("Power Reactor Status Report for "), nth(REPORT_MONTHS, F.col("o_orderkey")), F.lit(" "),
                     (F.pmod("o_custkey", F.lit(31)) + 1).cast("string"), F.lit(", 2024"))
    return o.select("o_orderkey", report_date(title).cast("string").alias("report_date"))


@register("unit_flags", "SELECT l_orderkey, l_linenumber, l_quantity > 0 AS online, l_quantity * 2.5 >= 100 AS full_power FROM lineitem")
def _unit_flags(spark, sf_dir):
    power = F.col("l_quantity") * 2.5
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", power_online(power).alias("online"), power_full(power).alias("full_power"))


ROUTES = ("/v2/electricity/rto/region-data/", " electricity ", "v2/", "/", "a//b", "a/../b", "v2/natural-gas/./x", "petroleum/pri")
ROUTES_OUT = ("electricity/rto/region-data", "electricity", "v2", None, None, None, None, "petroleum/pri")


@register("normalize_route", f"SELECT event_id, {sql_nth(ROUTES_OUT, 'event_id')} AS route FROM events")
def _normalize_route(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", normalize_route(nth(ROUTES, F.col("event_id"))).alias("route"))


@register("display_name", "SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' Unit ' || p_size || '  plant', '(?i)\\bunit\\s*\\d+\\b', '', 'g'), '\\s+', ' ', 'g')) AS display FROM part")
def _display_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", display_name(F.concat(
        F.col("p_name"), F.lit(" Unit "), F.col("p_size").cast("string"), F.lit("  plant"))).alias("display"))


@register("limit_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500 OFFSET 1000")
def _limit_page(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    last = limit_page(rows, order, 1000).orderBy(F.col("o_totalprice"), F.col("o_orderkey").desc()).first()
    price = F.col("o_totalprice")
    return limit_page(rows, order, 500, (price < last.o_totalprice) | (
        (price == last.o_totalprice) & (F.col("o_orderkey") > last.o_orderkey)))

