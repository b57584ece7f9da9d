"""Search and news payloads, logged model responses."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.text import strip


def _get(item: str | Column, *names: str) -> Column:
    """First key that is present, trimmed; empty when none is."""
    found = F.coalesce(*[F.try_variant_get(item, f"$.{n}", "string") for n in names])
    return strip(F.coalesce(found, F.lit("")))


def normalize_news(payloads: DataFrame, key: str = "query_id", body: str = "body") -> DataFrame:
    """News articles to search results; blank titles or URLs are dropped."""
    listed = F.expr(f"try_variant_get(try_parse_json({body}), '$.articles', 'array<variant>')")
    items = payloads.select(key, F.posexplode(listed).alias("pos", "item"))
    seen = _get("item", "seendate")
    rows = items.select(
        key, "pos", _get("item", "title").alias("title"), _get("item", "url").alias("url"),
        seen.alias("snippet"), _get("item", "domain").alias("domain"),
        F.nullif(seen, F.lit("")).alias("published_at"),
        _get("item", "language").alias("language"),
        _get("item", "sourcecountry").alias("source_country"))
    return rows.where("title <> '' and url <> ''")


def normalize_web_results(payloads: DataFrame, key: str = "query_id",
                          body: str = "body") -> DataFrame:
    """Web search results; the first occurrence of a URL within a query wins."""
    listed = F.expr(f"try_variant_get(try_parse_json({body}), '$', 'array<variant>')")
    items = payloads.select(key, F.posexplode(listed).alias("pos", "item"))
    rows = items.select(
        key, "pos", _get("item", "title").alias("title"), _get("item", "href", "url").alias("url"),
        _get("item", "body", "description").alias("snippet"),
        F.nullif(_get("item", "date"), F.lit("")).alias("published_at"),
        F.nullif(_get("item", "source"), F.lit("")).alias("source_engine"))
    rows = rows.where("title <> '' and url <> ''")
    best = rows.groupBy(key, "url").agg(F.min_by(
        F.struct("pos", "title", "snippet", "published_at", "source_engine"), "pos").alias("r"))
    return best.select(key, "url", "r.*")


def _output_items(payloads: DataFrame, key: str, body: str) -> DataFrame:
    listed = F.expr(f"try_variant_get(try_parse_json({body}), '$.output', 'array<variant>')")
    return payloads.select(key, F.posexplode(listed).alias("item_pos", "item"))


def _first_by_url(rows: DataFrame, key: str) -> DataFrame:
    usable = rows.where("coalesce(url, '') <> ''")
    place = F.struct(*[c for c in rows.columns if c.endswith("pos")])
    rest = F.struct(*[c for c in rows.columns if c not in (key, "url")])
    return usable.groupBy(key, "url").agg(F.min_by(rest, place).alias("r")).select(key, "url", "r.*")


def response_answers(payloads: DataFrame, key: str = "response_id", body: str = "body") -> DataFrame:
    """Answer text: output texts of one response joined in order."""
    listed = F.expr(f"try_variant_get(try_parse_json({body}), '$.output', 'array<variant>')")

    def kind(v: Column, name: str) -> Column:
        return F.coalesce(F.try_variant_get(v, "$.type", "string") == name, F.lit(False))

    messages = F.filter(listed, lambda i: kind(i, "message"))
    contents = F.flatten(F.transform(messages, lambda i: F.coalesce(
        F.try_variant_get(i, "$.content", "array<variant>"), F.array().cast("array<variant>"))))
    texts = F.transform(F.filter(contents, lambda c: kind(c, "output_text")),
                        lambda c: F.coalesce(F.try_variant_get(c, "$.text", "string"), F.lit("")))
    return payloads.select(key, strip(F.array_join(F.coalesce(texts, F.array()), "")).alias("answer"))


def response_citations(payloads: DataFrame, key: str = "response_id",
                       body: str = "body") -> DataFrame:
    """URL citations in order, first per URL within a response."""
    items = _output_items(payloads, key, body).where(
        F.try_variant_get("item", "$.type", "string") == "message")
    parts = items.select(key, "item_pos", F.posexplode(F.expr(
        "try_variant_get(item, '$.content', 'array<variant>')")).alias("part_pos", "part")).where(
            F.try_variant_get("part", "$.type", "string") == "output_text")
    notes = parts.select(key, "item_pos", "part_pos", F.posexplode(F.expr(
        "try_variant_get(part, '$.annotations', 'array<variant>')")).alias("note_pos", "note")).where(
            F.try_variant_get("note", "$.type", "string") == "url_citation")
    url = F.try_variant_get("note", "$.url", "string")
    rows = notes.select(
        key, "item_pos", "part_pos", "note_pos", url.alias("url"),
        F.coalesce(F.nullif(F.try_variant_get("note", "$.title", "string"), F.lit("")), url).alias("title"))
    return _first_by_url(rows, key)


def response_sources(payloads: DataFrame, key: str = "response_id",
                     body: str = "body") -> DataFrame:
    """Consulted sources in order, first per URL within a response."""
    items = _output_items(payloads, key, body).where(
        F.try_variant_get("item", "$.type", "string") == "web_search_call")
    found = items.select(key, "item_pos", F.posexplode(F.expr(
        "try_variant_get(item, '$.action.sources', 'array<variant>')")).alias("source_pos", "source"))
    url = F.try_variant_get("source", "$.url", "string")
    rows = found.select(
        key, "item_pos", "source_pos", url.alias("url"),
        F.coalesce(F.nullif(F.try_variant_get("source", "$.title", "string"), F.lit("")), url).alias("title"),
        F.try_variant_get("source", "$.type", "string").alias("source_type"))
    return _first_by_url(rows, key)
