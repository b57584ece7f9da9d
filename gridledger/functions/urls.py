"""URL normal forms and host expressions.

Parts come from one regular expression rather than ``parse_url``, which raises
on malformed input.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.text import strip

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _netloc(url: Column) -> Column:
    """Authority part without user information, lower case."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 2)), "^.*@", "")


def hostname(url: Column) -> Column:
    """Lower-case host, no port, ``www.`` kept."""
    return F.regexp_replace(_netloc(url), r":\d*$", "")


def host(url: Column) -> Column:
    """Lower-case host without one leading ``www.``; empty when there is none."""
    return F.regexp_replace(hostname(url), r"^www\.", "")


def _site(url: Column, scheme: Column) -> Column:
    """Host plus port, default ports dropped."""
    port = F.regexp_extract(_netloc(url), r":(\d+)$", 1)
    default = ((port == "") | ((scheme == "https") & (port == "443"))
               | ((scheme == "http") & (port == "80")))
    return F.when(default, host(url)).otherwise(F.concat(host(url), F.lit(":"), port))


def _path(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_extract(url, _URL, 3), "/+", "/")
    return F.when(path == "", "/").otherwise(path)


def url_path(url: Column) -> Column:
    """Path without slashes at the ends."""
    return F.regexp_replace(F.regexp_extract(url, _URL, 3), "^/+|/+$", "")


def _unquote(text: Column) -> Column:
    plain = F.replace(text, F.lit("+"), F.lit(" "))
    return F.coalesce(F.try_url_decode(text), plain)


def _quote(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")),
                     F.lit("*"), F.lit("%2A"))


def _clean_query(query: Column) -> Column:
    """Query string without tracking parameters, re-encoded pair by pair."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")

    def key(p: Column) -> Column:
        return _unquote(F.substring_index(p, "=", 1))

    def value(p: Column) -> Column:
        return _unquote(F.regexp_extract(p, "^[^=]*=(.*)$", 1))

    kept = F.filter(pairs, lambda p: ~F.lower(key(p)).isin(*fv.TRACKING_PARAMETERS)
                    & ~F.lower(key(p)).startswith("utm_"))
    return F.array_join(F.transform(kept, lambda p: F.concat(_quote(key(p)), F.lit("="),
                                                             _quote(value(p)))), "&")


def canonicalize_url(c: Column) -> Column:
    """Identity of a search result: tracking parameters and fragment removed."""
    url = strip(c)
    scheme = F.lower(F.regexp_extract(url, _URL, 1))
    path = _path(url)
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(url, _URL, 4)
    kept = F.when(query == "", "").otherwise(_clean_query(query))
    tail = F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))
    whole = F.concat(scheme, F.lit("://"), _site(url, scheme), path, tail)
    return F.when((scheme == "") | (host(url) == ""), url).otherwise(whole)


def dedup_url(c: Column) -> Column:
    """Identity of a document: the whole query is dropped, a trailing slash stays."""
    scheme = F.lower(F.regexp_extract(c, _URL, 1))
    bare = F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), "/+", "/")
    whole = F.concat(scheme, F.lit("://"), _site(c, scheme), _path(c))
    return F.when(scheme == "", F.when(bare == "", "/").otherwise(bare)).otherwise(whole)


def in_domains(host_col: Column, domains: Sequence[str]) -> Column:
    """Host equals a listed domain or is one of its sub-domains."""
    hit = host_col.isin(*domains)
    for domain in domains:
        hit = hit | host_col.endswith(f".{domain}")
    return hit


def approved(url: Column, domains: Sequence[str], https_only: bool = True) -> Column:
    name = F.regexp_replace(F.regexp_replace(hostname(url), r"^\.+|\.+$", ""), r"^www\.", "")
    hit = in_domains(name, domains)
    return (F.lower(F.regexp_extract(url, _URL, 1)) == "https") & hit if https_only else hit


def raw_site(url: Column) -> Column:
    """Second part of a split on ``/``: port, user and ``www.`` are kept."""
    return F.when(url.contains("://"), F.lower(F.get(F.split(url, "/"), F.lit(2))))
