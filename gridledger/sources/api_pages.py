"""Landed API responses: data pages, route metadata, fetch outcomes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions.text import normalize_route, strip


def _text(path: str, of: str = "doc") -> Column:
    return F.try_variant_get(of, path, "string")


def api_page_status(pages: DataFrame, body: str = "body", strict_rows: bool = False) -> DataFrame:
    """Add ``rows`` (array of objects), ``row_count``, ``total``, ``reject_reason``.

    ``strict_rows`` follows the single-page client: any item that is not an
    object rejects the page and a missing or unusable ``total`` stays null.
    Otherwise other items are skipped and ``total`` defaults to the row count.
    """
    df = pages.withColumn("doc", F.try_parse_json(body))
    df = df.withColumns({
        "_items": F.expr("try_variant_get(doc, '$.response.data', 'array<variant>')"),
        "_response": F.try_variant_get("doc", "$.response", "map<string,variant>"),
        "_error": F.coalesce(_text("$.error.message"), _text("$.error.code"), _text("$.error")),
        "_total": _text("$.response.total"),
    })
    objects = F.filter("_items", lambda i: F.try_variant_get(i, "$", "map<string,variant>").isNotNull())
    df = df.withColumn("rows", objects).withColumn("row_count", F.size(F.coalesce("rows", F.array())))
    number = F.when(strip(F.col("_total")).rlike(r"^[+-]?\d+$"), F.trim("_total").try_cast("bigint"))
    has_error = F.coalesce(~F.col("_error").isin("", "false", "0"), F.lit(False))
    reason = (
        F.when(F.col("doc").isNull(), "invalid_json")
        .when(has_error, F.concat(F.lit("source_error: "), F.col("_error")))
        .when(F.col("_response").isNull(), "missing_response")
        .when(F.col("_items").isNull(), "missing_data_array")
    )
    if strict_rows:
        reason = F.coalesce(reason, F.when(F.size("_items") != F.col("row_count"), "non_object_row"))
        total = number
    else:
        reason = F.coalesce(reason, F.when(F.col("_total").isNotNull() & number.isNull(),
                                           "invalid_total"))
        total = F.coalesce(number, F.col("row_count").cast("bigint"))
    return (df.withColumns({"reject_reason": reason, "total": F.when(reason.isNull(), total)})
            .drop("doc", "_items", "_response", "_error", "_total"))


def explode_api_pages(pages: DataFrame, keep: tuple[str, ...], body: str = "body") -> DataFrame:
    """One row per data object of every usable page, fields as a text map."""
    good = api_page_status(pages, body).where("reject_reason is null")
    return good.select(*keep, "total", F.posexplode("rows").alias("pos", "_row")).select(
        *keep, "total", "pos", F.try_variant_get("_row", "$", "map<string,string>").alias("fields"))


def _named(items: Column, *extra: str) -> Column:
    """Array of structs with a non-blank trimmed id."""
    def build(i: Column) -> Column:
        return F.struct(*[strip(F.try_variant_get(i, f"$.{n}", "string")).alias(n)
                          for n in ("id", *extra)])

    return F.filter(F.transform(items, build), lambda s: F.coalesce(s["id"], F.lit("")) != "")


def parse_route_catalog(payloads: DataFrame, route: str = "route", body: str = "body") -> DataFrame:
    """Route metadata: frequencies, facets, data columns and child routes."""
    df = payloads.withColumn("doc", F.try_parse_json(body))

    def listed(name: str) -> Column:
        return F.expr(f"try_variant_get(doc, '$.response.{name}', 'array<variant>')")

    def names(items: Column, *extra: str) -> Column:
        return F.coalesce(_named(items, *extra), F.array())

    frequency = F.when(F.size(F.coalesce(listed("frequency"), F.array())) > 0,
                       listed("frequency")).otherwise(listed("frequencies"))
    others = [c for c in payloads.columns if c not in (route, body)]
    return df.select(
        *others,
        normalize_route(F.col(route)).alias("route"),
        *[strip(_text(f"$.response.{n}")).alias(n) for n in ("id", "name", "description")],
        names(frequency, "description").alias("frequencies"),
        names(listed("facets"), "description").alias("facets"),
        names(listed("data"), "description", "unit").alias("data_columns"),
        F.transform(names(listed("routes")), lambda s: s["id"]).alias("child_routes"),
        F.when(F.try_variant_get("doc", "$.response", "map<string,variant>").isNull(),
               "missing_response").alias("reject_reason"))


def fetch_status(code: Column) -> Column:
    """HTTP status code to outcome class."""
    return (
        F.when(code.isNull(), "failed")
        .when(code.isin(401, 403), "unauthorized")
        .when(code == 429, "rate_limited")
        .when(code >= 500, "unavailable")
        .when((code >= 200) & (code < 300), "success")
        .otherwise("invalid_response")
    )


def classify_fetch_status(log: DataFrame, code: str = "status_code") -> DataFrame:
    return log.withColumn("fetch_status", fetch_status(F.col(code)))
