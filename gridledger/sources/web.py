"""Web pages: two text extractors.

Comments, scripts and styles end at their own mark whatever they hold. Other hidden tags may
nest and be closed in any order: the page is cut at them, and one fold over these few tags
tells for each piece how many are open, so unclosed, nested, crossed and stray tags hide what
a tolerant parser hides. White space beside line breaks is dropped.
"""
from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.plan import compute_once
from gridledger.functions.text import SPACE, squeeze, strip

# Text of a hidden tag that is never closed reaches to the end of the page.
HIDDEN = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in fv.BLOCKED_TAGS)
#: Text that no tag inside can end, and hidden tags that are counted.
RAW = r"(?is)<!--.*?(?:-->|\z)|" + "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style"))
COUNTED = rf"(?i)</?(?:{'|'.join(t for t in fv.BLOCKED_TAGS if t not in ('script', 'style'))})\b[^>]*>"
BREAKS = rf"(?i)</?(?:{'|'.join(fv.BREAK_TAGS)})\b[^>]*>"
#: A title that is never closed reaches to the end of the page.
TITLE = r"(?is)<title\b[^>]*>(.*?)(?:</title\s*>|\z)"
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
#: All named references of HTML, from the standard library's table.
NAMED = json.dumps({f"&{name}": char for name, char in html5.items() if name.endswith(";")})


def _character(reference: Column) -> Column:
    """Character of one reference; an unknown or impossible one stays as it is."""
    body = F.substring(reference, F.lit(3), F.length(reference) - 3)
    code = F.when(reference.rlike("^&#[xX]"), F.conv(F.substring(body, F.lit(2), F.length(body)), 16, 10)).otherwise(body).try_cast("int")
    valid = code.between(1, 55295) | code.between(57344, 1114111)
    numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    named = F.try_element_at(F.from_json(F.lit(NAMED), "map<string,string>"), reference)
    return F.coalesce(F.when(reference.startswith("&#"), numeric).otherwise(named), reference)


def decode_entities(c: Column) -> Column:
    """Character references decoded once, from left to right."""
    found = F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))
    pieces = F.zip_with(F.split(c, REFERENCE, -1), F.transform(found, _character),
                        lambda text, char: F.concat(text, F.coalesce(char, F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.array_join(pieces, "")).otherwise(c)


def seen(html: Column) -> Column:
    """The page without what hidden tags hold; a space stands where something was taken out."""
    text = F.regexp_replace(html, RAW, " ")
    tags = F.regexp_extract_all(text, F.lit(COUNTED), F.lit(0))
    change = lambda t: F.when(t.startswith("</"), -1).when(t.endswith("/>"), 0).otherwise(1)
    depth = F.aggregate(tags, F.array(F.lit(0)), lambda acc, t: F.concat(
        acc, F.array(F.greatest(F.lit(0), F.element_at(acc, -1) + change(t)))))
    pieces = F.zip_with(F.split(text, COUNTED, -1), depth, lambda piece, open_tags: F.when(open_tags == 0, piece))
    return F.when(text.rlike(COUNTED), F.array_join(pieces, " ")).otherwise(text)


def page_title(html: Column) -> Column:
    return squeeze(decode_entities(F.regexp_replace(F.regexp_extract(html, TITLE, 1), "<[^>]*>", " ")))


def page_text(html: Column) -> Column:
    """Text of a page without its hidden parts, one line per block."""
    text = F.regexp_replace(html, BREAKS, "\n")
    text = decode_entities(F.regexp_replace(text, "<[^>]*>", " "))
    text = F.regexp_replace(text, "[ \t]+", " ")
    return strip(F.regexp_replace(text, rf"{SPACE}*\n{SPACE}*", "\n"))


def extract_page_text(pages: DataFrame, html: str = "html", content_type: str | None = None,
                      max_chars: int | None = None, min_chars: int = 80) -> DataFrame:
    """Add ``title``, ``text`` and ``reject_reason``.

    Whole texts are kept; ``max_chars`` (``PAGE_CHARS`` for the compatible
    setting) cuts them. Plain text passes through, other types are rejected.
    """
    source = F.col(html)
    kind = F.lower(F.col(content_type)) if content_type else F.lit("text/html")
    plain = kind == "text/plain"
    text = F.when(plain, strip(source)).otherwise(page_text(F.col("_seen")))
    if max_chars is not None:
        text = strip(F.substring(text, 1, max_chars))
    out = compute_once(pages, {"_seen": F.when(~plain, seen(source))})
    out = compute_once(out, {"title": F.when(plain, "").otherwise(page_title(F.col("_seen"))), "text": text}).drop("_seen")
    known = kind.isin("text/html", "application/xhtml+xml", "text/plain")
    return out.withColumn("reject_reason", F.when(~known, "unsupported_content_type").when(
        F.length(F.coalesce("text", F.lit(""))) < min_chars, "insufficient_text"))


_PIECE = r"(?s)<[^>]*>[^<]*"
_OPENS_TEXT = rf"(?is)^<(?:{'|'.join(fv.BLOCK_TEXT_TAGS)})\b[^>]*>"


def page_blocks(html: Column) -> Column:
    """Text right after a listed tag, or any run of at least 40 characters."""
    pieces = F.regexp_extract_all(F.regexp_replace(html, HIDDEN, ""), F.lit(_PIECE), F.lit(0))
    chunks = F.transform(pieces, lambda p: F.struct(
        F.rlike(p, F.lit(_OPENS_TEXT)).alias("listed"),
        squeeze(decode_entities(F.regexp_replace(p, r"(?s)^<[^>]*>", ""))).alias("text")))
    kept = F.filter(chunks, lambda k: (k["text"] != "") & (k["listed"] | (F.length(k["text"]) >= 40)))
    return F.array_join(F.transform(kept, lambda k: k["text"]), "\n")


def extract_page_blocks(pages: DataFrame, html: str = "html", content_type: str | None = None,
                        min_chars: int = 40) -> DataFrame:
    """Add ``title``, ``text``, ``reject_reason``; a JSON body is kept as text."""
    source = F.col(html)
    is_json = F.lower(F.col(content_type)).contains("json") if content_type else F.lit(False)
    title = F.coalesce(F.nullif(page_title(source), F.lit("")), F.lit("Official source"))
    out = compute_once(pages, {
        "title": F.when(is_json, "Structured official response").otherwise(title),
        "text": F.when(is_json, source).otherwise(page_blocks(source))})
    bad_json = is_json & F.try_parse_json(source).isNull()
    return out.withColumn("reject_reason", F.when(bad_json, "invalid_json").when(
        ~is_json & (F.length("text") < min_chars), "insufficient_text"))
