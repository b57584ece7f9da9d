"""Text expressions (JVM-side columns, no Python UDF)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv

# White space as a Unicode-aware engine sees it; valid for Java and RE2 alike.
SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def norm_text(c: Column) -> Column:
    """Lower case, every run outside a-z0-9 becomes one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Collapse white-space runs to one space and strip."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def blank(c: Column) -> Column:
    """True for null or white-space-only text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def text_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def tokenize(c: Column) -> Column:
    """Distinct search terms of at least three characters, stopwords removed."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9][a-z0-9&.-]+"), F.lit(0))
    return F.array_except(F.filter(words, lambda w: F.length(w) >= 3),
                          text_array(fv.SEARCH_STOPWORDS))


def _answer_term(word: Column) -> Column:
    bare = F.replace(F.btrim(word, F.lit("._-")), F.lit("&"), F.lit("and"))
    longer = F.length(bare) > 4

    def cut(n: int) -> Column:
        return F.substr(bare, F.lit(1), F.length(bare) - n)

    return (
        F.when(longer & bare.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(longer & bare.endswith("s") & ~bare.endswith("ss"), cut(1))
        .otherwise(bare)
    )


def answer_terms(c: Column) -> Column:
    """Distinct terms with plural and hyphen variants aligned."""
    words = F.regexp_extract_all(F.replace(F.lower(c), F.lit("-"), F.lit(" ")),
                                 F.lit(r"[a-z0-9][a-z0-9&.]+"), F.lit(0))
    terms = F.filter(F.transform(words, _answer_term), lambda w: F.length(w) >= 3)
    return F.array_except(terms, text_array(fv.ANSWER_STOPWORDS))


def content_fingerprint(c: Column, max_chars: int | None = None) -> Column:
    """SHA-256 of the lower-cased, white-space-collapsed text.

    The whole text counts by default; ``max_chars`` (``FINGERPRINT_CHARS`` for
    the compatible setting) compares only the leading window.
    """
    body = squeeze(F.lower(c))
    if max_chars is not None:
        body = F.substring(body, 1, max_chars)
    return F.sha2(body, 256)


def contains_count(text: Column, terms: Sequence[str]) -> Column:
    """Number of listed terms that are substrings of ``text``."""
    total = F.lit(0)
    for term in terms:
        total = total + text.contains(term).cast("int")
    return total


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.contains(term)
    return hit


def has_word(normalized: Column, term: str) -> Column:
    """Whole-word match on ``norm_text`` output: pad both sides, then look up."""
    return F.concat(F.lit(" "), normalized, F.lit(" ")).contains(f" {term} ")


def matched_terms(text: Column, terms: Column) -> Column:
    """Elements of the row's own ``terms`` array that occur in ``text``."""
    return F.filter(terms, lambda t: F.contains(text, t))


def extract_nodes(c: Column) -> Column:
    """Price-node mentions, upper case, hyphenated hubs, first-seen order."""
    found = F.regexp_extract_all(c, F.lit(fv.NODE_PATTERN), F.lit(0))
    spelled = F.transform(found, lambda m: F.replace(F.replace(
        F.upper(m), F.lit("NP15"), F.lit("NP-15")), F.lit("SP15"), F.lit("SP-15")))
    return F.array_distinct(spelled)


def extract_entities(c: Column) -> Column:
    """Canonical spelling of every listed entity mentioned, in listing order."""
    return F.array_compact(F.array_distinct(F.array(*[
        F.when(c.rlike(rf"(?i)\b{pattern}\b"), F.lit(name)) for pattern, name in fv.ENTITY_MENTIONS
    ])))


def display_name(c: Column) -> Column:
    """Plant name without its unit number."""
    return squeeze(F.regexp_replace(c, r"(?i)\bunit\s*\d+\b", ""))


def is_lmp_component(c: Column) -> Column:
    """Accepted price component names, or ``*_LMP`` that is not a sub-component."""
    name = F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    part = name.contains("MCE") | name.contains("MCC") | name.contains("MCL")
    return name.isin(*fv.LMP_COMPONENTS) | (name.endswith("_LMP") & ~part)


def is_hourly_energy_unit(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[ -]", "").isin(*fv.HOURLY_ENERGY_UNITS)


def equivalent_mw(value: Column, unit: Column) -> Column:
    """Energy over one hour equals average power; other units have no equivalent."""
    return F.when(is_hourly_energy_unit(unit), value)


def series_id(code: Column, metric: Column) -> Column:
    return F.format_string("EBA.%s-ALL.%s.H", code, F.upper(metric))


def normalize_route(c: Column) -> Column:
    """API route without slashes at the ends or version prefix; null when invalid."""
    route = F.regexp_replace(F.regexp_replace(F.trim(c), "^/+|/+$", ""), "^v2/", "")
    bad = F.exists(F.split(route, "/"), lambda s: s.isin("", ".", ".."))
    return F.when(~bad, route)


def freshness_need(c: Column) -> Column:
    """live, current, historical (a year is named) or stable."""
    text = norm_text(c)
    return (
        F.when(contains_any(text, fv.LIVE_TERMS), "live")
        .when(contains_any(text, fv.CURRENT_TERMS), "current")
        .when(text.rlike(r"\b(19|20)\d{2}\b"), "historical")
        .otherwise("stable")
    )


def power_online(power: Column) -> Column:
    return power > 0


def power_full(power: Column) -> Column:
    return power >= 100
