"""Question labels by keyword tables.

The terms of all vocabularies a classifier needs are found in one pass over the
text (``find_terms``); a vocabulary is then a literal array of (order, label, term
numbers) compared with the found numbers by higher-order functions. The plan stays
small however many terms there are: no explode, no join, no shuffle.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.plan import compute_once
from gridledger.functions.terms import find_terms
from gridledger.functions.text import extract_nodes, norm_text, strip, text_array
from gridledger.functions.times import local_day

Rules = Sequence[tuple[str, Sequence[str]]]


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(terms: Sequence[str]) -> str:
    return f"array({', '.join(_quote(t) for t in terms)})"


class Terms:
    """Distinct terms of several vocabularies, searched together.

    ``found`` is the name of the column that holds ``find_terms`` output.
    """

    def __init__(self, *vocabularies: Rules, found: str = "_found") -> None:
        self.found = found
        self.terms = tuple(dict.fromkeys(t for rules in vocabularies for _, ts in rules for t in ts))
        self._number = {t: i for i, t in enumerate(self.terms)}

    def search(self, df: DataFrame, text: Column) -> DataFrame:
        return compute_once(df, {self.found: find_terms(text, self.terms)})

    def _rows(self, rules: Rules) -> str:
        """SQL literal: array of (ord, label, ids, lens) in listing order."""
        rows = []
        for i, (label, terms) in enumerate(rules):
            ids = ", ".join(str(self._number[t]) for t in terms)
            lens = ", ".join(f"named_struct('id', {self._number[t]}, 'len', {len(t)})" for t in terms)
            rows.append(f"named_struct('ord', {i}, 'label', {_quote(label)}, 'ids', array({ids}), 'lens', array({lens}))")
        return f"array({', '.join(rows)})"

    def any_of(self, terms: Sequence[str]) -> Column:
        """Whether any listed term was found."""
        ids = ", ".join(str(self._number[t]) for t in terms)
        return F.expr(f"arrays_overlap({self.found}, array({ids}))")

    def best_label(self, rules: Rules, default: str, longest: bool = True) -> Column:
        """Label with most found terms, then the longest one (when ``longest``), then order."""
        length = (f"coalesce(array_max(transform(filter(v.lens, t -> array_contains({self.found}, t.id)),"
                  " t -> t.len)), 0)") if longest else "0"
        row = F.expr(
            f"array_max(transform(filter({self._rows(rules)}, v -> arrays_overlap(v.ids, {self.found})),"
            f" v -> named_struct('n', size(array_intersect(v.ids, {self.found})), 'len', {length},"
            " 'ord', -v.ord, 'label', v.label)))")
        return F.coalesce(row["label"], F.lit(default))

    def first_rule(self, rules: Rules, default: str | None = None) -> Column:
        """First rule with any found term."""
        label = F.expr(f"get(filter({self._rows(rules)}, v -> arrays_overlap(v.ids, {self.found})), 0).label")
        return F.coalesce(label, F.lit(default)) if default is not None else label

    def labels(self, rules: Rules) -> Column:
        """Labels of all rules with a found term, in listing order."""
        return F.expr(f"transform(filter({self._rows(rules)}, v -> arrays_overlap(v.ids, {self.found})), v -> v.label)")


def _whole_words(rules: Rules) -> Rules:
    """Terms padded with spaces, for look-up in padded ``norm_text`` output."""
    return [(label, tuple(dict.fromkeys(f" {t.replace('-', ' ')} " for t in terms)))
            for label, terms in rules]


def _literal_start(pattern: str) -> str:
    """Literal text every match of one alternative must begin with."""
    plain = pattern.replace(r"\b", "")
    stop = next((i for i, ch in enumerate(plain) if ch in "[?("), len(plain))
    return plain[: stop - 1] if plain[stop: stop + 1] == "?" else plain[:stop]


def _pattern_hints(rules: Sequence[tuple[str, str]]) -> Rules:
    return [(label, tuple(dict.fromkeys(_literal_start(p) for p in pattern.split("|"))))
            for label, pattern in rules]


def first_pattern(terms: Terms, text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """First rule whose regular expression matches, else null.

    A pattern is only tried on rows where the literal start of one of its
    alternatives was found.
    """
    out = F.lit(None).cast("string")
    for (label, pattern), (_, hints) in reversed(list(zip(rules, _pattern_hints(rules)))):
        out = F.when(terms.any_of(hints) & text.rlike(pattern), label).otherwise(out)
    return out


def keywords(c: Column) -> Column:
    """Lower-case word tokens of three or more characters, in order."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_-]+"), F.lit(0)),
                    lambda w: F.length(w) >= 3)


# Literal spellings that must occur before a mention pattern is worth testing.
_MENTION_HINTS = [(name, (name.lower(), name.lower().replace("-", "")) if "15" in name else (name.lower(),))
                  for _, name in fv.ENTITY_MENTIONS]


def classify_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    """Commodity, topic, geography, entities and keywords."""
    terms = Terms(fv.COMMODITY_TERMS, fv.TOPIC_TERMS, fv.GEOGRAPHY_TERMS, _MENTION_HINTS)
    df = terms.search(questions, F.lower(text))
    df = compute_once(df, {
        "commodity": terms.best_label(fv.COMMODITY_TERMS, "unknown"),
        "topic": terms.best_label(fv.TOPIC_TERMS, "general"),
        "geography": terms.best_label(fv.GEOGRAPHY_TERMS, "unknown")})
    hints = dict(_MENTION_HINTS)
    mentions = [F.when(terms.any_of(hints[name]) & F.col(text).rlike(rf"(?i)\b{pattern}\b"), F.lit(name))
                for pattern, name in fv.ENTITY_MENTIONS]
    return df.withColumns({
        "entities": F.array_compact(F.array_distinct(F.array(*mentions))),
        "keywords": keywords(F.col(text))}).drop("_found")


# ---- fixed values: topic groups and deductions ------------------------------
EXACT_TOPICS = ("price settlement generation storage demand supply capacity reserves"
                " inventory").split()
CURRENT_TOPICS = ("asset_status outage price settlement news weather generation storage demand"
                  " supply").split()
CROSS_CHECK_TOPICS = "price settlement asset_status outage regulatory news".split()
STRUCTURED_INTENTS = "price generation outage congestion fundamentals weather".split()
WEB_INTENTS = ("news regulatory gas outage generation congestion fundamentals weather"
               " general").split()


def plan_capabilities(classified: DataFrame) -> DataFrame:
    """Topic to required capabilities and source counts."""
    topic = F.col("topic")
    capabilities = F.array_compact(F.array(
        F.when(topic.isin(*EXACT_TOPICS), "structured_market_data"),
        F.when(topic.isin("asset_status", "outage"), "asset_status"),
        F.when(topic.isin("regulatory", "policy"), "regulatory_documents"),
        F.when(topic == "weather", "weather_data"),
        F.when(topic.isin("company", "project", "news"), "company_news"),
        F.lit("general_web_research")))
    cross = topic.isin(*CROSS_CHECK_TOPICS)
    return classified.withColumns({
        "capabilities": capabilities, "needs_exact": topic.isin(*EXACT_TOPICS),
        "needs_current": topic.isin(*CURRENT_TOPICS), "needs_cross_check": cross,
        "minimum_sources": F.when(cross, 2).otherwise(1)})


_ROUTE_DOMAINS = _whole_words(fv.DOMAIN_TERMS)
_ROUTE_PLACES = _whole_words(fv.ROUTE_GEOGRAPHY_TERMS)
_ROUTE_ENTITIES = _whole_words([(e, (e,)) for e in fv.ROUTE_ENTITIES])


_PLANNED_TYPE = "array<struct<provider_id: string, priority: int, source_role: string, retrieval_modes: array<string>>>"


def _planned_literal() -> str:
    """SQL map of domain to its planned providers; Catalyst folds it to one literal."""
    parts = []
    for name in dict.fromkeys(row[0] for row in fv.ROUTE_PROVIDERS):
        own = [row[1:] for row in fv.ROUTE_PROVIDERS if row[0] == name]
        items = ", ".join(f"named_struct('provider_id', {_quote(p)}, 'priority', {n}, 'source_role', {_quote(role)}, 'retrieval_modes', {_array(modes)})"
                          for n, (p, role, modes) in enumerate(own, 1))
        parts.append(f"{_quote(name)}, array({items})")
    return f"map({', '.join(parts)})"


_PLANNED = _planned_literal()


def route_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    """Domain, mode, freshness, geography, entities, providers, cross-source flag."""
    terms = Terms(_ROUTE_DOMAINS, _ROUTE_PLACES, _ROUTE_ENTITIES, [("explain", fv.EXPLAIN_TERMS)],
                  [("energy", fv.GENERAL_ENERGY_WORDS)], [("live", fv.LIVE_TERMS)],
                  [("current", fv.CURRENT_TERMS)])
    # The pad lets a term with spaces around it match at both ends. It cannot make
    # an unpadded term appear, except one ending in a space, which is tested apart.
    norm = norm_text(F.col(text))
    df = terms.search(questions, F.concat(F.lit(" "), norm, F.lit(" ")))
    fallback = F.when(terms.any_of(fv.GENERAL_ENERGY_WORDS), "general_energy").otherwise("unknown")
    current = [t for t in fv.CURRENT_TERMS if not t.endswith(" ")]
    inner = [t for t in fv.CURRENT_TERMS if t.endswith(" ")]
    ends_inside = F.lit(False)
    for term in inner:
        ends_inside = ends_inside | (terms.any_of([term]) & norm.contains(term))
    freshness = (
        F.when(terms.any_of(fv.LIVE_TERMS), "live")
        .when(terms.any_of(current) | ends_inside, "current")
        .when(norm.rlike(r"\b(19|20)\d{2}\b"), "historical").otherwise("stable"))
    df = compute_once(df, {
        "domain": F.coalesce(F.nullif(terms.best_label(_ROUTE_DOMAINS, "", longest=False), F.lit("")), fallback),
        "geography": terms.first_rule(_ROUTE_PLACES), "_explain": terms.any_of(fv.EXPLAIN_TERMS)})
    domain = F.col("domain")
    mode = (
        F.when(domain == "unknown", "clarification")
        .when(domain.isin(*fv.DOCUMENT_DOMAINS), "official_document")
        .when(F.col("_explain") | (domain == "general_energy"), "hybrid_research")
        .otherwise("structured_data"))
    planned = F.expr(f"coalesce(try_element_at({_PLANNED}, domain), cast(array() AS {_PLANNED_TYPE}))")
    df = compute_once(df, {"planned_providers": planned})
    df = df.withColumns({"mode": mode, "providers": F.transform("planned_providers", lambda p: p["provider_id"]), "freshness": freshness,
                         "entities": terms.labels(_ROUTE_ENTITIES)})
    cross = (domain != "unknown") & ((F.col("mode") == "hybrid_research")
                                     | domain.isin(*fv.CROSS_SOURCE_DOMAINS))
    return df.withColumn("cross_source", cross).drop("_found", "_explain")


def parse_market_questions(questions: DataFrame, as_of: str = "as_of",
                           text: str = "question") -> DataFrame:
    """Market, intent, nodes and a relative date."""
    terms = Terms(fv.MARKET_RULES, fv.INTENT_RULES, [("day", ("yesterday", "today"))])
    today = local_day(F.col(as_of))
    return compute_once(terms.search(questions, F.lower(text)), {
        "market": terms.first_rule(fv.MARKET_RULES, "GENERAL"),
        "intent": terms.first_rule(fv.INTENT_RULES, "general"),
        "nodes": extract_nodes(F.col(text)),
        "requested_date": F.when(terms.any_of(["yesterday"]), F.date_sub(today, 1))
                           .when(terms.any_of(["today"]), today)}).drop("_found")


def plan_research(parsed: DataFrame, text: str = "question") -> DataFrame:
    """Mode, source minimums, required connectors and ambiguity warnings."""
    intent = F.col("intent")
    structured, web = intent.isin(*STRUCTURED_INTENTS), intent.isin(*WEB_INTENTS)
    prices = (F.col("market") == "CAISO") & (intent == "price")
    reactor = F.lower(text).contains("diablo canyon")
    return parsed.withColumns({
        "mode": F.when(structured & web, "hybrid").when(structured, "structured_first").otherwise("web_first"),
        "needs_structured": structured, "needs_web": web,
        "minimum_primary": F.when(intent != "general", 1).otherwise(0),
        "minimum_total": F.when(web, 2).otherwise(1),
        "connectors": F.array_compact(F.array(
            F.when(prices, "caiso_oasis"), F.when(reactor, "nrc_reactor_status"))),
        "warnings": F.array_compact(F.array(
            F.when(prices & (F.size("nodes") == 0), "The requested price location is ambiguous."),
            F.when(prices & F.col("requested_date").isNull(),
                   "The requested market date is ambiguous.")))})


def with_source_intent(questions: DataFrame, text: str = "question") -> DataFrame:
    """Intent that selects a question's allowed domains."""
    terms = Terms(fv.SOURCE_INTENT_RULES)
    df = terms.search(questions, F.lower(text))
    return compute_once(df, {"source_intent": terms.first_rule(fv.SOURCE_INTENT_RULES, "general")}).drop("_found")


_METRIC_RULES = [(m, p) for m, _, p in fv.METRIC_PATTERNS]


def with_operating_labels(questions: DataFrame, text: str = "question") -> DataFrame:
    """Grid authority and operating metric a question names, by pattern priority."""
    terms = Terms(_pattern_hints(fv.AUTHORITY_PATTERNS), _pattern_hints(_METRIC_RULES), found="_hints")
    low = F.lower(text)
    return compute_once(terms.search(questions, low), {
        "authority": first_pattern(terms, low, fv.AUTHORITY_PATTERNS),
        "metric": first_pattern(terms, low, _METRIC_RULES)}).drop("_hints")


def metric_label(metric: Column) -> Column:
    out = F.lit(None).cast("string")
    for code, label, _ in fv.METRIC_PATTERNS:
        out = F.when(metric == code, label).otherwise(out)
    return out


def authority_code(name: Column) -> Column:
    codes = dict(fv.AUTHORITY_SPELLINGS)
    out = F.lit(None).cast("string")
    for label, _ in fv.AUTHORITY_PATTERNS:
        out = F.when(name == label, codes[label]).otherwise(out)
    return out


def resolve_operating_questions(questions: DataFrame, text: str = "question") -> DataFrame:
    """Authority and metric by pattern priority, and what is missing."""
    df = with_operating_labels(questions, text)
    missing = F.array_compact(F.array(F.when(F.col("authority").isNull(), "balancing authority"),
                                      F.when(F.col("metric").isNull(), "metric")))
    ident = F.format_string("EBA.%s-ALL.%s.H", authority_code(F.col("authority")), F.col("metric"))
    return df.withColumns({
        "missing": missing,
        "series_id": F.when(F.size(missing) == 0, ident),
        "status": F.when(F.size(missing) == 0, "resolved").otherwise("needs_clarification")})


def retrieval_methods(provider: tuple, has_credentials: Column, has_license: Column) -> Column:
    """Retrieval methods of one catalogue row, null when the provider is skipped."""
    # ---- fixed values: connector kind to method
    method = {"structured_api": "structured_api", "structured_download": "bulk_download",
              "document_search": "document_search", "web_research": "official_web",
              "file_import": "bulk_download"}
    _, _, _, primary, access, *_, kinds = provider
    names = list(dict.fromkeys(method[k] for k in kinds))
    if primary and "official_web" not in names:
        names.append("official_web")
    full = text_array(names)
    if access == "public_api_key":
        full = F.when(has_credentials, full).otherwise(text_array([n for n in names if n != "structured_api"]))
    if access == "optional_licensed":
        full = F.when(has_license, full)
    return full


def plan_retrieval(matched: DataFrame, credentials: str = "credentials",
                   licenses: str = "licenses", key: str = "question_id") -> DataFrame:
    """(question, provider, method) in trial order; skipped providers keep a reason."""
    from gridledger import dims

    steps = F.lit(None).cast("array<string>")
    for row in dims.provider_rows():
        steps = F.when(F.col("provider_id") == row[0], retrieval_methods(
            row, F.array_contains(credentials, row[0]), F.array_contains(licenses, row[0]))).otherwise(steps)
    flat = matched.select(key, credentials, licenses,
                          F.posexplode("providers").alias("provider_pos", "provider_id"))
    flat = flat.withColumn("methods", steps)
    out = flat.select(key, "provider_pos", "provider_id", F.posexplode_outer("methods").alias(
        "method_pos", "method"))
    return out.withColumns({
        "skip_reason": F.when(F.col("method").isNull(), "licensed access is not configured"),
        "method_pos": F.coalesce("method_pos", F.lit(0))})


def resolve_hub(text: str) -> Column:
    """Struct (location, display_name): exact spelling, else exactly one embedded hub.

    ``text`` names a column holding ``norm_text`` output.
    """
    from gridledger.dims import norm

    hubs = []
    for i, (canonical, display, words) in enumerate(fv.HUBS):
        inside = sorted({norm(w) for w in (display, *words)})
        hubs.append(f"named_struct('location', {_quote(canonical)}, 'display_name', {_quote(display)},"
                    f" 'exact', {_array([norm(canonical), *inside])}, 'inside', {_array(inside)})")
    table = f"array({', '.join(hubs)})"
    exact = f"filter({table}, h -> array_contains(h.exact, {text}))"
    inside = f"filter({table}, h -> exists(h.inside, w -> contains({text}, w)))"
    return F.expr(f"coalesce(get({exact}, 0), CASE WHEN size({inside}) = 1 THEN get({inside}, 0) END)")


def resolve_price_market(text: str) -> Column:
    """DAM, FMM, RTM; UNSPECIFIED when none is named, AMBIGUOUS when several are."""
    rows = ", ".join(f"named_struct('code', {_quote(code)}, 'terms', {_array(terms)})"
                     for code, *_, terms in fv.PRICE_MARKETS)
    found = F.expr(f"transform(filter(array({rows}), m -> exists(m.terms, t -> contains({text}, t))), m -> m.code)")
    return F.when(F.size(found) == 0, "UNSPECIFIED").when(F.size(found) > 1, "AMBIGUOUS").otherwise(
        F.get(found, F.lit(0)))


def is_blank_question(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""
