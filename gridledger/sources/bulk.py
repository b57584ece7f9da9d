"""Bulk-file manifests: nested JSON envelopes to file records."""
from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.text import norm_text, strip
from gridledger.functions.urls import approved
from gridledger.session import cut_lineage


def _entries(node: Column) -> Column:
    return F.map_entries(F.from_json(node, "map<string,string>"))


def _is_object(node: Column) -> Column:
    return F.coalesce(node.startswith("{"), F.lit(False))


def _is_list(node: Column) -> Column:
    return F.coalesce(node.startswith("["), F.lit(False))


def _is_record(node: Column) -> Column:
    """A file record: scalar keys name an id with a description, or a URL with a name."""
    scalars = F.filter(_entries(node), lambda e: e["value"].isNotNull() & (strip(e["value"]) != "")
                       & ~e["value"].startswith("{") & ~e["value"].startswith("["))
    keys = F.transform(scalars, lambda e: F.lower(strip(e["key"])))

    def has(names: Sequence[str]) -> Column:
        return F.arrays_overlap(keys, F.array(*[F.lit(n) for n in names]))

    ident, data_set = has(fv.MANIFEST_ID_KEYS), has(fv.MANIFEST_SET_KEYS)
    title, url = has(fv.MANIFEST_TITLE_KEYS), has(fv.MANIFEST_URL_KEYS)
    found = (ident & (data_set | title | url)) | (url & (data_set | title))
    return _is_object(node) & F.coalesce(found, F.lit(False))


def _step() -> Column:
    """Nested children of a node that is no record."""
    key = lambda e: F.regexp_replace(F.lower(strip(e["key"])), "[- ]", "_")
    nested = lambda v: _is_object(v) | _is_list(v)
    items = F.transform(
        F.from_json("node", "array<string>"),
        lambda v, i: F.struct(v.alias("node"), F.lit(None).cast("string").alias("inherited"),
                              F.concat(F.col("place"), F.array(i)).alias("place"),
                              F.lit(False).alias("is_record")))
    members = F.transform(
        _entries(F.col("node")),
        lambda e, i: F.struct(
            e["value"].alias("node"),
            F.when(_is_object(e["value"]), F.when(
                key(e).isin(*fv.MANIFEST_CONTAINERS), F.col("inherited")).otherwise(
                    F.coalesce(F.nullif(strip(e["key"]), F.lit("")), F.col("inherited")))
                   ).alias("inherited"),
            F.concat(F.col("place"), F.array(i)).alias("place"),
            F.lit(False).alias("is_record")))
    children = F.when(_is_list(F.col("node")), items).when(_is_object(F.col("node")), members)
    return F.filter(children, lambda c: nested(c["node"]))


def flatten_bulk_manifest(manifests: DataFrame, key: str = "manifest_id",
                          body: str = "body") -> DataFrame:
    """Records of each manifest in document order, first of equal ones kept.

    Envelopes are followed to any depth: each level is one step over the nodes
    still open, until none is. A JSON value counts as nested when its text starts
    with a brace or bracket.
    """
    rows = manifests.select(key, F.trim(F.col(body)).alias("node"),
                            F.lit(None).cast("string").alias("inherited"),
                            F.array().cast("array<int>").alias("place"))
    rows = rows.withColumn("is_record", _is_record(F.col("node")))
    settled = []
    while True:
        rows = cut_lineage(rows)
        settled.append(rows.where("is_record"))
        if rows.where("not is_record").isEmpty():
            break
        rows = (rows.where("not is_record").select(key, F.explode(_step()).alias("n"))
                .select(key, "n.node", "n.inherited", "n.place", _is_record(F.col("n.node")).alias("is_record")))
    rows = reduce(DataFrame.unionByName, settled)
    fields = F.from_json("node", "map<string,string>")
    rows = rows.withColumn("raw", F.when(F.col("is_record"), fields))
    own = F.coalesce(*[F.nullif(F.col("raw")[k], F.lit("")) for k in fv.MANIFEST_ID_KEYS])
    rows = rows.withColumn("inherited", F.when(own.isNull(), F.col("inherited")))

    def first(*names: str) -> Column:
        return F.coalesce(*[F.nullif(F.col("raw")[n], F.lit("")) for n in names], F.lit(""))

    signature = [
        F.trim(F.coalesce(F.col("inherited"), first("identifier", "id"))).alias("sig_id"),
        F.trim(first("data_set", "dataset", "name")).alias("sig_set"),
        F.trim(first("accessURL", "accessUrl", "access_url", "downloadURL", "download_url",
                     "url")).alias("sig_url")]
    records = rows.where("is_record").select(key, "raw", "inherited", "place", *signature)
    best = records.groupBy(key, "sig_id", "sig_set", "sig_url").agg(
        F.min_by(F.struct("raw", "inherited", "place"), F.col("place")).alias("r"))
    return best.select(key, "r.raw", "r.inherited", "r.place", F.lit(None).cast("string").alias("reject_reason"))


def resolve_bulk_files(records: DataFrame) -> DataFrame:
    """Identifier, data set, title and download URL by first-non-blank choice."""
    def pick(*names: str) -> Column:
        return F.coalesce(*[F.nullif(strip(F.col("raw")[n]), F.lit("")) for n in names])

    ident = F.coalesce(F.nullif(strip(F.col("inherited")), F.lit("")),
                       pick("identifier", "id", "data_set", "dataset", "name"))
    explicit = pick("accessURL", "accessUrl", "access_url", "downloadURL", "downloadUrl",
                    "download_url", "url", "file_url", "link")
    named = pick("file_name", "filename", "file")
    root = F.lit(fv.BULK_ROOT)
    url = (
        F.when(explicit.isNotNull(), F.regexp_replace(explicit, "^http://", "https://"))
        .when(named.isNotNull(), F.concat(root, F.regexp_replace(named, "^/+", "")))
        .when(F.lower(F.col("identifier")).endswith(".zip"), F.concat(root, F.col("identifier")))
        .otherwise(F.concat(root, F.col("identifier"), F.lit(".zip")))
    )
    files = records.withColumns({
        "identifier": ident,
        "data_set": pick("data_set", "dataset", "dataSet", "name", "description"),
        "title": pick("title", "name", "description"),
        "last_updated": pick("last_updated", "lastUpdated"),
        "modified": pick("modified"),
        "category_id": pick("category_id", "categoryId"),
    })
    files = files.where(F.col("reject_reason").isNotNull() | (
        F.col("identifier").isNotNull() & F.col("data_set").isNotNull() & F.col("title").isNotNull()))
    files = files.withColumn("download_url", url)
    reason = F.coalesce("reject_reason", F.when(
        ~approved(F.col("download_url"), fv.BULK_DOMAINS), "unapproved_host"))
    return files.withColumn("reject_reason", reason)


def search_bulk_files(files: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Files whose id, data set and title contain every normalised term."""
    import re

    wanted = [re.sub(r"[^a-z0-9]+", " ", t.lower()).strip() for t in terms if t.strip()]
    hay = norm_text(F.concat_ws(" ", "identifier", "data_set", "title"))
    hit = F.lit(True)
    for term in wanted:
        hit = hit & hay.contains(term)
    return files.where(hit)
