"""Evidence scoring, grouping, gates and de-duplication."""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.numbers import round_half_up
from gridledger.functions.plan import compute_once
from gridledger.functions.text import (
    content_fingerprint, contains_count, matched_terms, strip, tokenize)
from gridledger.functions.urls import (
    canonicalize_url, dedup_url, host, in_domains, raw_site, url_path)
from gridledger.operators.ranking import top_k
from gridledger.session import cut_lineage


# ---- plans and results -------------------------------------------------------
def merge_results(*providers: DataFrame) -> DataFrame:
    """All providers' results in one table; fields a provider lacks are null."""
    out = providers[0]
    for more in providers[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def merge_queries(plans: DataFrame) -> DataFrame:
    """Ordered distinct plan queries plus one site query per official domain."""
    site = F.transform("official_domains", lambda d: F.concat(
        F.lit("site:"), d, F.lit(" "), F.col("question")))
    queries = F.transform(F.concat("search_queries", site), strip)
    return plans.withColumn("queries", F.array_distinct(F.filter(queries, lambda q: q != "")))


def with_plan_terms(plans: DataFrame) -> DataFrame:
    """Tokenise a plan once, before it meets its results."""
    def many(column: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(column, tokenize)))

    return plans.withColumns({
        "question_terms": tokenize(F.col("question")), "entity_terms": many("entities"),
        "geography_terms": many("geography"), "intent_terms": tokenize(F.col("intent"))})


def low_value(title: Column, snippet: Column, url: Column) -> Column:
    return F.lower(F.concat_ws(" ", title, snippet, url)).rlike(fv.LOW_VALUE_PATTERN)


def drop_low_value(results: DataFrame) -> DataFrame:
    """Results that are not login, registration or legal pages."""
    return results.where(~low_value(F.col("title"), F.col("snippet"), F.col("url")))


def _hits(text: Column, terms: str) -> Column:
    return F.size(matched_terms(text, F.col(terms)))


def _mentions(text: Column, names: str) -> Column:
    """Listed names, repeats included, that occur in the text."""
    return F.size(F.filter(names, lambda n: F.contains(text, F.lower(n))))


def score_discovery(df: DataFrame) -> DataFrame:
    """Add ``score``, ``official`` and ``matched`` to results joined with a plan.

    Needs the plan terms, ``host``, and the authority ``tier`` of the host.
    """
    df = compute_once(df, {"_text": F.lower(F.concat_ws(" ", "title", "snippet", "url"))})
    text, name = F.col("_text"), F.col("host")
    listed = F.exists("official_domains", lambda d: (
        (name == F.regexp_replace(F.lower(strip(d)), r"^www\.", ""))
        | name.endswith(F.concat(F.lit("."), F.regexp_replace(F.lower(strip(d)), r"^www\.", "")))))
    official = F.col("tier").isNotNull() | F.coalesce(listed, F.lit(False))
    tier = F.when(F.col("tier").isNull(), 0.0).when(F.col("tier") == "controlling", 10.0).when(
        F.col("tier") == "primary", 7.0).otherwise(4.0)
    low = F.lower("title")
    snippet = F.least(F.length(F.coalesce("snippet", F.lit(""))) / 500, F.lit(1.5))
    score = (
        _hits(text, "question_terms") * 1.2 + _hits(text, "entity_terms") * 2.5
        + _hits(text, "geography_terms") * 2.0 + _hits(text, "intent_terms") * 0.75
        + F.when(official, 12.0).otherwise(0.0) + tier
        + F.when(name.endswith(".gov"), 10.0).otherwise(0.0)
        + F.when(name.endswith(".edu"), 5.0).otherwise(0.0)
        + _mentions(low, "entities") * 4.0 + _mentions(low, "geography") * 3.0
        + F.when(F.coalesce(F.col("published_at"), F.lit("")) != "", 1.0).otherwise(0.0) + snippet
        - F.when(low_value(F.col("title"), F.col("snippet"), F.col("url")), 15.0).otherwise(0.0))
    every = F.array_union(F.array_union("question_terms", "entity_terms"),
                          F.array_union("geography_terms", "intent_terms"))
    return compute_once(df, {
        "official": official, "score": round_half_up(score),
        "matched": F.array_sort(matched_terms(text, every))}).drop("_text")


def score_page(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Add ``relevance`` and ``matched`` to fetched pages joined with their plan.

    Terms are looked up in the whole text; ``max_chars`` (``FINGERPRINT_CHARS``
    for the compatible setting) restricts the look-up to the leading window.
    """
    body = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    df = compute_once(df, {"_text": F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), body))})
    text = F.col("_text")
    low = F.lower(F.coalesce("title", F.lit("")))
    score = (
        _hits(text, "question_terms") * 1.0 + _hits(text, "entity_terms") * 3.0
        + _hits(text, "geography_terms") * 2.5
        + _mentions(low, "entities") * 4.0 + _mentions(low, "geography") * 3.0
        + F.when(F.col("tier").isNotNull(), 6.0).otherwise(0.0)
        + F.least(F.length("text") / 8000, F.lit(2.0))
        + F.least(F.col("discovery_score") / 20, F.lit(2.0)))
    every = F.array_union(F.array_union("question_terms", "entity_terms"), F.col("geography_terms"))
    return compute_once(df, {"relevance": round_half_up(score),
                             "matched": F.array_sort(matched_terms(text, every))}).drop("_text")


def source_tier(name: Column) -> Column:
    return (F.when(in_domains(name, fv.CONTROLLING_DOMAINS), "controlling")
            .when(in_domains(name, fv.AUTHORITATIVE_DOMAINS), "authoritative")
            .when(name != "", "supporting").otherwise("unknown"))


def score_source(results: DataFrame, question: str = "question") -> DataFrame:
    """Tier bonus plus question-term and energy-term overlap."""
    name = host(F.col("url"))
    domain = F.coalesce(F.nullif("domain", F.lit("")), name)
    tier = source_tier(name)
    bonus = (F.when(tier == "controlling", 50.0).when(tier == "authoritative", 30.0)
             .when(tier == "supporting", 10.0).otherwise(0.0))
    edge = r"^[.,?!:;()\[\]{}]+|[.,?!:;()\[\]{}]+$"
    terms = F.array_distinct(F.filter(F.transform(
        F.split(strip(F.col(question)), r"\s+"), lambda w: F.lower(F.regexp_replace(w, edge, ""))),
        lambda w: F.length(w) >= 3))
    df = compute_once(results, {
        "domain": domain, "source_tier": tier, "_bonus": bonus, "_terms": terms,
        "_text": F.lower(F.concat_ws(" ", "title", "snippet", domain))})
    score = (F.col("_bonus") + F.size(matched_terms(F.col("_text"), F.col("_terms"))) * 4.0
             + contains_count(F.col("_text"), fv.ENERGY_TERMS) * 1.5)
    return compute_once(df, {"score": score}).drop("_text", "_bonus", "_terms")


def group_candidates(scored: DataFrame, key: str = "question_id") -> DataFrame:
    """Per canonical URL: best-scored result, first position, distinct queries.

    One pass over the scored rows: they are first reduced per (URL, query), which
    combines on the map side, so the list of a URL is bounded by its plan's queries.
    """
    fields = [c for c in scored.columns if c not in (key, "url", "query")]
    per_query = scored.groupBy(key, "url", "query").agg(
        F.max_by(F.struct(*fields), F.struct("score", (-F.col("pos")).alias("p"))).alias("best"),
        F.min("pos").alias("p"))
    asked = F.when(F.coalesce("query", F.lit("")) != "", F.struct("p", "query"))
    grouped = per_query.groupBy(key, "url").agg(
        F.max_by("best", F.struct(F.col("best.score"), (-F.col("best.pos")).alias("p"))).alias("best"),
        F.min("p").alias("first_pos"), F.array_sort(F.collect_list(asked)).alias("asked"))
    return grouped.select(
        key, "url", *[F.col(f"best.{c}").alias(c) for c in fields if c != "pos"],
        F.col("first_pos").alias("pos"), F.transform("asked", lambda s: s["query"]).alias("queries"))


def provider_counts(results: DataFrame, key: str = "question_id") -> DataFrame:
    """Results and distinct canonical URLs per provider, and over all providers (a null provider).

    Counted once per URL and provider first, so the totals add up these few rows.
    """
    per_url = results.withColumn("_url", canonicalize_url(F.col("url"))).groupBy(key, "provider", "_url").agg(
        F.count("*").alias("_n"))
    totals = per_url.groupBy(key, "_url").agg(F.sum("_n").alias("_n")).groupBy(key).agg(
        F.sum("_n").alias("result_count"), F.count("_url").alias("distinct_urls"))
    parts = per_url.groupBy(key, "provider").agg(F.sum("_n").alias("result_count"), F.count("_url").alias("distinct_urls"))
    return parts.unionByName(totals.withColumn("provider", F.lit(None).cast("string")))


# ---- page and model gates ----------------------------------------------------
def page_gate(df: DataFrame, min_chars: int = 300, min_relevance: float = 5.0) -> DataFrame:
    """``gate_reason`` is null for an accepted page; ``accepted`` mirrors it."""
    fetch_fault = F.col("reject_reason") if "reject_reason" in df.columns else F.lit(None)
    reason = (F.when(fetch_fault.isNotNull(), fetch_fault)
              .when(F.length(F.coalesce("text", F.lit(""))) < min_chars, "insufficient_text")
              .when(F.col("relevance") < min_relevance, "below_relevance_gate"))
    return df.withColumns({"gate_reason": reason, "accepted": reason.isNull()})


def accept_validated(docs: DataFrame, min_score: float = 0.62) -> DataFrame:
    """Clamp the model score, normalise its scope, decide acceptance.

    The model's own relevance flag matters only for ``answerable``.
    """
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("relevance_score")))
    scope = F.lower(strip(F.col("source_scope")))
    scope = F.when(scope.isin("direct", "partial", "background", "irrelevant"), scope).otherwise("irrelevant")
    docs = compute_once(docs, {"semantic_score": score, "scope": scope})
    ok = (F.col("semantic_score") >= min_score) & F.col("scope").isin("direct", "partial")
    return docs.withColumns({
        "accepted": ok,
        "answerable": F.coalesce(F.col("answerable") & F.col("relevant") & ok, F.lit(False))})


def is_generic_homepage(title: Column, url: Column, scope: Column) -> Column:
    return (F.lower(strip(title)).isin(*fv.GENERIC_TITLES)
            | ((url_path(url) == "") & (scope != "direct")))


def packet_rollup(docs: DataFrame, key: str = "question_id") -> DataFrame:
    """Controlling and independent-domain counts and sufficiency of accepted pages."""
    name = host(F.col("url"))
    out = docs.groupBy(key).agg(
        F.count("*").alias("document_count"),
        F.count_if(F.col("source_tier").isin("controlling", "primary")).alias("controlling_count"),
        F.count_distinct(F.nullif(name, F.lit(""))).alias("domain_count"))
    controlling, domains = F.col("controlling_count") >= 1, F.col("domain_count") >= 2
    return out.withColumns({
        "sufficient": controlling | domains,
        "reason": F.when(controlling, "controlling_source").when(domains, "independent_domains")
                   .otherwise("insufficient")})


def validated_rollup(docs: DataFrame, key: str = "question_id") -> DataFrame:
    """Sufficiency of model-validated documents; rejected ones only count as seen."""
    ok = F.col("accepted")
    out = docs.groupBy(key).agg(
        F.count_if(ok).alias("accepted_count"),
        F.count_if(ok & (F.col("scope") == "direct")).alias("direct_count"),
        F.count_if(ok & F.col("answerable")).alias("answerable_count"),
        F.count_if(ok & F.col("source_tier").isin("controlling", "primary")).alias("controlling_count"),
        F.count_distinct(F.when(ok, raw_site(F.col("url")))).alias("domain_count"))
    enough = (F.col("answerable_count") >= 1) & (
        (F.col("direct_count") >= 1) | (F.col("controlling_count") >= 1) | (F.col("domain_count") >= 2))
    return out.withColumns({
        "sufficient": enough,
        "reason": F.when(enough, "answerable_evidence")
                   .when(F.col("accepted_count") == 0, "all_rejected").otherwise("not_enough_direct")})


def limitations(reasons: DataFrame, key: str = "question_id", pos: str = "pos",
                text: str = "limitation") -> DataFrame:
    """Distinct limitation texts per group with the position that orders them."""
    return reasons.where(F.coalesce(F.col(text), F.lit("")) != "").groupBy(key, text).agg(
        F.min(pos).alias("first_pos"))


# ---- greedy de-duplication ---------------------------------------------------
def with_dedup_keys(docs: DataFrame, max_chars: int | None = None) -> DataFrame:
    return compute_once(docs, {
        "dedup_url": dedup_url(F.col("url")),
        "fingerprint": content_fingerprint(F.col("text"), max_chars),
        "generic": is_generic_homepage(F.col("title"), F.col("url"), F.col("scope"))})


#: Documents of a packet, copies in both keys folded, that one task walks at once (some 20 MB of keys).
WALK = 100_000


def _walked(table: pa.Table) -> pa.Table:
    """The retained documents of one packet: a sequential walk in position order."""
    table = table.sort_by("pos")
    urls, prints, kept = set(), set(), []
    for n, (url, fingerprint) in enumerate(zip(table["dedup_url"].to_pylist(), table["fingerprint"].to_pylist(), strict=True)):
        if url not in urls and fingerprint not in prints:
            urls.update({url} - {None})  # a missing key equals no other
            prints.update({fingerprint} - {None})
            kept.append(n)
    return table.take(pa.array(kept, pa.int64()))


def _first_positions(rows: DataFrame, key: str, column: str) -> DataFrame:
    return rows.groupBy(key, column).agg(F.min("pos").alias(f"_first_{column}"))


def _retained_in_rounds(rows: DataFrame, key: str) -> DataFrame:
    """Retained rows of packets of any size: a document that is first among the undecided in both its URL group
    and its fingerprint group is retained, and undecided ones sharing a key with it are rejected, until all are decided."""
    parts: list[DataFrame] = []
    while not rows.isEmpty():
        marked = (rows.join(_first_positions(rows, key, "dedup_url"), [key, "dedup_url"])
                  .join(_first_positions(rows, key, "fingerprint"), [key, "fingerprint"]))
        kept = cut_lineage(marked.where((F.col("pos") == F.col("_first_dedup_url"))
                                        & (F.col("pos") == F.col("_first_fingerprint")))
                           .select(key, "dedup_url", "fingerprint", "pos"))
        parts.append(kept)
        rows = cut_lineage(
            rows.join(kept.select(key, "dedup_url"), [key, "dedup_url"], "left_anti")
            .join(kept.select(key, "fingerprint"), [key, "fingerprint"], "left_anti"))
    return merge_results(*parts)


def greedy_dedup(docs: DataFrame, key: str = "packet_id", walk: int = WALK) -> DataFrame:
    """Walk each packet in ``pos`` order; drop a document whose URL or fingerprint
    equals that of a *retained* one. Adds ``retained``.

    Only slim key columns move, and copies equal in both keys are folded on the map side first. A packet
    of at most ``walk`` folded documents is walked by one task, so a chain of any length costs one shuffle and
    the number of packets does not matter. Larger packets, where there are any, are settled in rounds over all
    of them together; those reduce groups by a minimum only.
    """
    keyed = docs.where(~F.col("generic")).groupBy(key, "dedup_url", "fingerprint").agg(F.min("pos").alias("pos"))
    keyed = cut_lineage(keyed)
    large = keyed.groupBy(key).agg(F.count("*").alias("_size")).where(F.col("_size") > walk).select(key)
    small, rounds = keyed, None
    if not large.isEmpty():
        large = cut_lineage(large)
        small = keyed.join(large, key, "left_anti")
        rounds = _retained_in_rounds(cut_lineage(keyed.join(large, key, "left_semi")), key)
    kept = small.groupBy(key).applyInArrow(_walked, small.schema)
    kept = kept if rounds is None else merge_results(kept, rounds)
    return (docs.join(kept.select(key, "pos", F.lit(True).alias("_kept")), [key, "pos"], "left")
            .withColumn("retained", F.coalesce("_kept", F.lit(False))).drop("_kept"))


def dedup_capped(docs: DataFrame, key: str = "question_id", cap: int = 6) -> DataFrame:
    """``greedy_dedup`` for packets that ``cap_documents`` already bounded.

    At most ``cap`` rows per packet are folded in one array, so the sequential
    walk needs one shuffle and no rounds. Packets larger than that go through
    ``greedy_dedup``.
    """
    sizes = docs.where(~F.col("generic")).groupBy(key).agg(F.count("*").alias("_size"))
    large = cut_lineage(sizes.where(F.col("_size") > cap).select(key))
    if not large.isEmpty():
        rest = docs.join(large, key, "left_anti")
        return dedup_capped(rest, key, cap).unionByName(greedy_dedup(docs.join(large, key, "left_semi"), key))
    rows = docs.where(~F.col("generic")).select(key, "pos", "dedup_url", "fingerprint")
    walk = F.array_sort(F.collect_list(F.struct("pos", "dedup_url", "fingerprint")))
    packets = rows.groupBy(key).agg(walk.alias("_docs"))
    start = F.filter("_docs", lambda d: F.lit(False))
    keep = F.reduce("_docs", start, lambda acc, d: F.when(
        F.exists(acc, lambda k: (k["dedup_url"] == d["dedup_url"]) | (k["fingerprint"] == d["fingerprint"])),
        acc).otherwise(F.concat(acc, F.array(d))))
    kept = packets.select(key, F.explode(keep).alias("k")).select(
        key, F.col("k.pos").alias("pos"), F.lit(True).alias("_kept"))
    return (docs.join(kept, [key, "pos"], "left")
            .withColumn("retained", F.coalesce("_kept", F.lit(False))).drop("_kept"))


def retained_rollup(docs: DataFrame, key: str = "question_id") -> DataFrame:
    """After de-duplication a packet is sufficient when anything was retained."""
    out = docs.groupBy(key).agg(F.count_if("retained").alias("retained_count"))
    return out.withColumns({
        "sufficient": F.col("retained_count") > 0,
        "reason": F.when(F.col("retained_count") > 0, "unique_evidence").otherwise(
            "only_duplicates_or_generic")})
