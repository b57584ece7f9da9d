"""Landed formats. Spark derives the payloads from the given tables, then parses them."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from gridledger.operators.joins import match_plants, validate_requests
from gridledger.operators.reactors import plant_status
from gridledger.operators.records import observed_text, reactor_records
from gridledger.plans.reactors import answer_reactors, latest_report, newest_units, plant_query
from gridledger.queries.base import QUESTIONS_SQL, SP, joined, nth, questions, register, spread_table, sql_nth, table
from gridledger.sources.api_pages import (
    api_page_status, classify_fetch_status, explode_api_pages, parse_route_catalog)
from gridledger.sources.articles import (
    normalize_news, normalize_web_results, response_answers, response_citations,
    response_sources)
from gridledger.session import shared_folder
from gridledger.sources.bulk import flatten_bulk_manifest, resolve_bulk_files, search_bulk_files
from gridledger.sources.landed import land_files
from gridledger.sources.prices import (
    detect_price_errors, price_archive_rows, price_error, read_price_archives, typed_price_rows)
from gridledger.sources.reactors import parse_reactor_lines, parse_reactor_tables
from gridledger.sources.series import parse_series_lines, read_series_archives


def fill(template: str, **columns):
    """Literal text with ``{name}`` places replaced by columns."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), c.cast("string"))
    return out


def pick(i, *choices):
    """Choice number ``i mod n``."""
    out = choices[-1]
    for n, c in enumerate(choices[:-1]):
        out = F.when(F.pmod(i, F.lit(len(choices))) == n, c).otherwise(out)
    return out


# ---- price archives, one per customer; a long or quoted note stands under one of the accepted headers ----
#: Archives made by a task.
ARCHIVES = 2_000
HEADER = "INTERVALSTARTTIME_GMT,INTERVALENDTIME_GMT,NODE_ID,MARKET_RUN_ID,LMP_TYPE,MW,opr dt\n"


def _zip_bodies(batches):
    import io
    import zipfile

    for batch in batches:
        bodies = []
        for key, price in zip(batch["c_custkey"], batch["c_acctbal"]):
            kind, fault = key % 10, key % 100
            # A cell longer than 131,072 characters, and one of two headers with the same normal form.
            price = price if kind != 1 else f'0,"{"x" * 140_000}"' if fault == 11 else price
            rows = "".join(f'2024-01-0{d}T07:00:00-00:00,2024-01-0{d}T08:00:00-00:00,TH_NP15_GEN-APND,DAM,LMP,'
                           f'{price},"café, {key}"\n' for d in (1, 2))
            text = (HEADER + rows).encode("windows-1252" if kind == 4 else "utf-8-sig" if kind == 3 else "utf-8")
            members = {5: [("error.xml", f"<ERROR><ERR_DESC> no\n data {key} </ERR_DESC></ERROR>".encode())],
                       6: [("a.csv", text), ("b.CSV", text)], 7: [("readme.txt", b"x")],
                       9: [("../a.csv", text)]}.get(kind, [("sub/a.csv", text)])
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w") as archive:
                for name, data in members:
                    archive.writestr(name, data)
            body = buffer.getvalue()
            if fault == 21:  # damaged content: the stored bytes no longer have their checksum
                body = body.replace(b"TH_NP15", b"TH_XX15")
            if fault == 31:  # a member that claims to be encrypted
                at = body.index(b"PK\x01\x02")
                body = body[:6] + b"\x01" + body[7:at + 8] + b"\x01" + body[at + 9:]
            if kind == 8:
                body = f"<ERR_CODE>7</ERR_CODE> refused {key}".encode()
            bodies.append(b"" if key % 50 == 0 else body)
        yield pd.DataFrame({"path": "c" + batch["c_custkey"].astype(str) + ".zip", "content": bodies})


def landed(files, spark):
    """Folder in which the archives lie as files."""
    folder = shared_folder(spark)
    land_files(files, folder)
    return folder


def archive_files(spark, sf_dir):
    """One price archive for each customer."""
    customers = spread_table(spark, sf_dir, "customer", "c_custkey", "c_acctbal", rows=ARCHIVES)
    return customers.mapInPandas(_zip_bodies, "path string, content binary")


def archives(spark, sf_dir):
    """Records of one price archive for each customer, read by path."""
    rows = read_price_archives(spark, landed(archive_files(spark, sf_dir), spark))
    return rows.withColumn("path", F.regexp_extract("path", r"([^/]+)\.zip$", 1))


ARCHIVE_SQL = """arch AS (SELECT c_custkey, 'c' || c_custkey AS path, c_acctbal, CASE WHEN c_custkey % 50 = 0 THEN 'empty_response'
  WHEN c_custkey % 10 = 5 THEN 'xml_only' WHEN c_custkey % 10 = 6 THEN 'multiple_csv' WHEN c_custkey % 10 = 7 THEN 'no_csv'
  WHEN c_custkey % 100 = 21 THEN 'corrupt_member' WHEN c_custkey % 100 = 31 THEN 'unreadable_member'
  WHEN c_custkey % 10 = 8 THEN 'bad_zip' WHEN c_custkey % 10 = 9 THEN 'unsafe_path' END AS reject FROM customer)"""


@register("read_price_archives", f"""WITH {ARCHIVE_SQL}
SELECT path, row_no, 'ok' AS state, CASE WHEN c_custkey % 100 = 11 THEN repeat('x', 140000) ELSE 'caf' || chr(233) || ', ' || c_custkey END AS note FROM arch, (VALUES (1), (2)) r(row_no) WHERE reject IS NULL
UNION ALL SELECT path, 0, reject, NULL FROM arch WHERE reject IS NOT NULL""")
def _read_archives(spark, sf_dir):
    return archives(spark, sf_dir).select("path", "row_no", F.coalesce("reject_reason", F.lit("ok")).alias("state"),
                                          F.col("operating_date").alias("note"))


@register("price_archive_table", f"""WITH {ARCHIVE_SQL}
SELECT path, row_no, coalesce(reject, 'ok') AS state, CASE WHEN reject IS NULL AND c_custkey % 100 <> 11 THEN CAST(c_acctbal AS VARCHAR) WHEN reject IS NULL THEN '0.0' END AS price
FROM arch, (VALUES (0), (1), (2)) r(row_no) WHERE (reject IS NULL) = (row_no > 0)""")
def _archive_table(spark, sf_dir):
    rows = price_archive_rows(archive_files(spark, sf_dir))
    return rows.select(F.regexp_extract("path", r"(.+)\.zip$", 1).alias("path"), "row_no", F.coalesce("reject_reason", F.lit("ok")).alias("state"),
                       F.col("price").try_cast("double").cast("string").alias("price"))


@register("price_archive_fields", f"""WITH {ARCHIVE_SQL}
SELECT path, row_no, 'TH_NP15_GEN-APND' AS location, 'DAM' AS market, 'LMP' AS component, CASE WHEN c_custkey % 100 = 11 THEN 0 ELSE c_acctbal END AS price,
  '2024-01-0' || row_no || ' 07:00:00' AS start_text FROM arch, (VALUES (1), (2)) r(row_no) WHERE reject IS NULL""")
def _archive_fields(spark, sf_dir):
    rows = typed_price_rows(archives(spark, sf_dir).where("reject_reason is null"))
    return rows.select("path", "row_no", "location", "market", "component", F.col("price_value").alias("price"),
                       F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_text"))


@register("detect_price_errors", f"""WITH {ARCHIVE_SQL}
SELECT path, reject AS reject_reason, CASE reject WHEN 'xml_only' THEN 'no data ' || c_custkey WHEN 'bad_zip' THEN '7 refused ' || c_custkey END AS message
FROM arch WHERE reject IS NOT NULL""")
def _detect_errors(spark, sf_dir):
    return detect_price_errors(archives(spark, sf_dir))


@register("price_error", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'No data ' || o_orderkey WHEN 1 THEN '101 text ' || o_orderkey
  WHEN 3 THEN 'slow down ' || o_orderkey END AS message FROM orders""")
def _price_error(spark, sf_dir):
    k = F.col("o_orderkey")
    body = pick(k, fill("<E><ERR_CODE>1</ERR_CODE><ERR_DESC> No\n  data {k} </ERR_DESC></E>", k=k),
                fill("<m:x><err_code>101</err_code> text {k}</m:x>", k=k), F.lit("<OK/>"),
                fill("<x><message>slow down {k}</message></x>", k=k))
    return table(spark, sf_dir, "orders").select("o_orderkey", price_error(body).alias("message"))


# ---- series archives: twenty customers each -------------------------------------------
#: Customers whose archives a task makes.
SERIES = 20_000


def _series_bodies(group):
    """One archive of a group's customers: a member for each, every sixth kind of member faulty in its own way."""
    import io
    import json
    import zipfile

    buffer = io.BytesIO()
    first = int(group["c_custkey"].min())
    with zipfile.ZipFile(buffer, "w") as archive:
        for key, name in sorted(zip(group["c_custkey"], group["c_name"], strict=True)):
            record = json.dumps({"series_id": f"S{key}", "name": name, "units": "MWh", "data": [["20240101T00Z", int(key)]]}).encode()
            second = {2: b'\xff{"series_id": "lost"}', 3: b"{broken"}.get(key % 6, b'{"category_id": 1}')
            archive.writestr(f"{key % 7}/{key}.txt", b"\xef\xbb\xbf" + record + b"\r\n" + second + b"\n")
        archive.writestr("readme.md", b"not a series")
    body = buffer.getvalue()
    for key in group["c_custkey"]:  # damaged members: the stored bytes no longer have their checksum
        if key % 6 == 1:
            body = body.replace(f'"S{key}"'.encode(), f'"X{key}"'.encode(), 1)
    body = {3: b"no archive", 8: b""}.get(first // 20 % 10, body)
    return pd.DataFrame({"path": [f"{first // 20}.zip"], "content": [body]})


@register("read_series_archives", """WITH c AS (SELECT c_custkey // 20 AS file, c_custkey, 'S' || c_custkey AS series_id, c_name, c_custkey % 6 AS kind,
    row_number() OVER (PARTITION BY c_custkey // 20 ORDER BY c_custkey) - 1 AS block, c_custkey // 20 % 10 IN (3, 8) AS lost FROM customer)
SELECT DISTINCT file, 0 AS block, -1 AS line_no, 'malformed_json' AS state, NULL AS series_id, NULL AS name FROM c WHERE lost
UNION ALL SELECT file, block, -1, 'malformed_json', NULL, NULL FROM c WHERE NOT lost AND kind = 1
UNION ALL SELECT file, block, 0, 'ok', series_id, c_name FROM c WHERE NOT lost AND kind <> 1
UNION ALL SELECT file, block, 1, CASE WHEN kind IN (2, 3) THEN 'malformed_json' ELSE 'no_series_id' END, NULL, NULL FROM c WHERE NOT lost AND kind <> 1""")
def _series_archives(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.expr("c_custkey div 20").alias("file"))
    customers = customers.repartition(max(1, customers.count() // SERIES + 1), "file")
    bodies = customers.groupBy("file").applyInPandas(_series_bodies, "path string, content binary")
    lines = parse_series_lines(read_series_archives(spark, landed(bodies, spark)))
    return lines.select(F.regexp_extract("file", r"(\d+)\.zip$", 1).cast("long").alias("file"), "block", F.col("row").alias("line_no"),
                        F.coalesce("reject_reason", F.lit("ok")).alias("state"), "series_id", "name")


# ---- bulk manifests, one per part -----------------------------------------------------
MANIFESTS = (
    '{"files":[{"identifier":"P{k}","data_set":"S{k}","title":"{n}","download_url":"http://www.eia.gov/{k}.zip","last_updated":" today "}]}',
    '{"dataset":[{"id":"Q{k}","name":"{n}","accessURL":"https://api.eia.gov/bulk/{k}.zip"},{"id":"Q{k}","name":"{n}","accessURL":"https://api.eia.gov/bulk/{k}.zip"}]}',
    '{"EBA{k}":{"name":"{n}","url":"https://api.eia.gov/{k}"},"note":"x"}',
    '{"data":{"items":[{"id":"R{k}","title":"{n}","name":"d","link":"https://evil.example.com/{k}.zip"}]}}',
    '[{"id":"T{k}.zip","title":"{n}","dataset":"d{k}"},{"id":"U{k}","description":"{n}","file_name":"/f{k}.zip"}]',
    '{"a":{"b":{"c":{"d":{"e":{"f":[{"g":{"h":{"i":{"j":{"k":{"id":"V{k}","title":"{n}"}}}}}}]}}}}}}',
    '{"files":[{"identifier":"W{k}","url":"https://eia.gov/{k}"},{"title":"no id"}]}',
    '{"bulk-files":{"response":[{"identifier":"X{k}","title":"{n}","data_set":"Energy {k}"}]}}',
)
MANIFEST_SQL = """man AS (SELECT p_partkey AS k, p_name AS n, p_partkey % 8 AS kind FROM part),
files AS (SELECT k, 'P' || k AS identifier, 'S' || k AS data_set, n AS title, 'https://www.eia.gov/' || k || '.zip' AS url, 'ok' AS state FROM man WHERE kind = 0
  UNION ALL SELECT k, 'Q' || k, n, n, 'https://api.eia.gov/bulk/' || k || '.zip', 'ok' FROM man WHERE kind = 1
  UNION ALL SELECT k, 'EBA' || k, n, n, 'https://api.eia.gov/' || k, 'ok' FROM man WHERE kind = 2
  UNION ALL SELECT k, 'R' || k, 'd', n, 'https://evil.example.com/' || k || '.zip', 'unapproved_host' FROM man WHERE kind = 3
  UNION ALL SELECT k, 'T' || k || '.zip', 'd' || k, n, 'https://api.eia.gov/bulk/T' || k || '.zip', 'ok' FROM man WHERE kind = 4
  UNION ALL SELECT k, 'U' || k, n, n, 'https://api.eia.gov/bulk/f' || k || '.zip', 'ok' FROM man WHERE kind = 4
  UNION ALL SELECT k, 'V' || k, NULL, n, NULL, 'none' FROM man WHERE kind = 5
  UNION ALL SELECT k, 'X' || k, 'Energy ' || k, n, 'https://api.eia.gov/bulk/X' || k || '.zip', 'ok' FROM man WHERE kind = 7)"""


def manifest_records(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_name")
    body = pick(k, *[fill(m, k=k, n=n) for m in MANIFESTS])
    return flatten_bulk_manifest(spread_table(spark, sf_dir, "part", "p_partkey", "p_name").select(k.alias("manifest_id"), body.alias("body")))


@register("flatten_bulk_manifest", f"""WITH {MANIFEST_SQL} SELECT k AS manifest_id, identifier, 'ok' AS state FROM files
UNION ALL SELECT k, 'W' || k, 'ok' FROM man WHERE kind = 6""")
def _flatten(spark, sf_dir):
    rec = manifest_records(spark, sf_dir)
    ident = F.coalesce(F.col("inherited"), F.col("raw")["identifier"], F.col("raw")["id"])
    return rec.select("manifest_id", ident.alias("identifier"), F.coalesce("reject_reason", F.lit("ok")).alias("state"))


@register("resolve_bulk_files", f"""WITH {MANIFEST_SQL}
SELECT k AS manifest_id, identifier, data_set, title, url AS download_url, state FROM files WHERE state <> 'none'""")
def _resolve(spark, sf_dir):
    files = resolve_bulk_files(manifest_records(spark, sf_dir))
    return files.select("manifest_id", "identifier", "data_set", "title", "download_url",
                        F.coalesce("reject_reason", F.lit("ok")).alias("state"))


@register("search_bulk_files", f"""WITH {MANIFEST_SQL} SELECT k AS manifest_id, identifier FROM files
WHERE contains(lower(identifier || ' ' || data_set || ' ' || title), 'widget') AND contains(lower(identifier || ' ' || data_set || ' ' || title), 'energy')""")
def _search(spark, sf_dir):
    files = resolve_bulk_files(manifest_records(spark, sf_dir))
    return search_bulk_files(files, ("Widget", " ENERGY-", " ")).select("manifest_id", "identifier")


# ---- API pages, one per order -----------------------------------------------------------
PAGES = (
    '{"response":{"total":"{t}","data":[{"period":"2024-{k}","value":"{v}"},7,{"period":"x","value":null}]}}',
    '{"response":{"data":[{"period":"2024-{k}","value":{v}}]}}', '{"error":{"message":"bad key {k}"}}',
    '{"error":"limit {k}"}', '{"response":[]}', '{"response":{"total":1,"data":{}}}',
    '{"response":{"total":"many","data":[]}}', '{broken', '{"response":{"total":{t},"data":[]},"error":""}',
)


def api_pages(spark, sf_dir):
    k = F.col("o_orderkey")
    t = F.pmod(k, F.lit(50))
    body = pick(k, *[fill(p, k=k, t=t, v=F.col("o_totalprice")) for p in PAGES])
    return spread_table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select(k.alias("page_id"), body.alias("body"))


@register("api_page_status", """SELECT o_orderkey AS page_id, CASE o_orderkey % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'source_error: bad key ' || o_orderkey
  WHEN 3 THEN 'source_error: limit ' || o_orderkey WHEN 4 THEN 'missing_response' WHEN 5 THEN 'missing_data_array' WHEN 6 THEN 'invalid_total'
  WHEN 7 THEN 'invalid_json' ELSE 'ok' END AS state,
  CASE o_orderkey % 9 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS row_count,
  CASE o_orderkey % 9 WHEN 0 THEN o_orderkey % 50 WHEN 1 THEN 1 WHEN 8 THEN o_orderkey % 50 ELSE -1 END AS total FROM orders""")
def _api_status(spark, sf_dir):
    out = api_page_status(api_pages(spark, sf_dir))
    return out.select("page_id", F.coalesce("reject_reason", F.lit("ok")).alias("state"), "row_count",
                      F.coalesce("total", F.lit(-1)).alias("total"))


@register("explode_api_pages", """SELECT o_orderkey AS page_id, 0 AS pos, '2024-' || o_orderkey AS period, CAST(o_totalprice AS VARCHAR) AS value FROM orders WHERE o_orderkey % 9 < 2
UNION ALL SELECT o_orderkey, 1, 'x', NULL FROM orders WHERE o_orderkey % 9 = 0""")
def _explode_api(spark, sf_dir):
    rows = explode_api_pages(api_pages(spark, sf_dir), ("page_id",))
    value = F.col("fields")["value"]
    return rows.select("page_id", "pos", F.col("fields")["period"].alias("period"),
                       value.try_cast("double").cast("string").alias("value"))


CODES = (200, 204, 401, 403, 404, 429, 500, 503, 302)


@register("classify_fetch_status", """SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'success' WHEN 1 THEN 'success' WHEN 2 THEN 'unauthorized' WHEN 3 THEN 'unauthorized'
  WHEN 5 THEN 'rate_limited' WHEN 6 THEN 'unavailable' WHEN 7 THEN 'unavailable' ELSE 'invalid_response' END AS fetch_status FROM orders""")
def _fetch_status(spark, sf_dir):
    code = pick(F.col("o_orderkey"), *[F.lit(c) for c in CODES])
    log = table(spark, sf_dir, "orders").select("o_orderkey", code.alias("status_code"))
    return classify_fetch_status(log).select("o_orderkey", "fetch_status")


# ---- route metadata (one per part) and requests (one per order) -------------------------
ROUTE_BODY = ('{"response":{"id":"r{k}","name":" Route {k} ","{f}":[{"id":"hourly","description":"h"},{"id":" "}],'
              '"facets":[{"id":"respondent"},{"id":"type{m}"}],"data":[{"id":"value","unit":" MWh "},{"id":"price{m}"},5],'
              '"routes":[{"id":"child{k}"},{"id":""}]}}')


def route_catalog(spark, sf_dir):
    k = F.col("p_partkey")
    f = F.when(F.pmod(k, F.lit(2)) == 0, "frequency").otherwise("frequencies")
    body = fill(ROUTE_BODY, k=k, f=f, m=F.pmod(k, F.lit(3)))
    return parse_route_catalog(spread_table(spark, sf_dir, "part", "p_partkey").select(
        F.concat(F.lit("/v2/parts/"), k.cast("string"), F.lit("/")).alias("route"), body.alias("body")))


@register("parse_route_catalog", """SELECT 'parts/' || p_partkey AS route, 'Route ' || p_partkey AS name, 'hourly' AS frequencies,
  'respondent|type' || p_partkey % 3 AS facets, 'value=MWh|price' || p_partkey % 3 || '=' AS data_columns, 'child' || p_partkey AS child_routes FROM part""")
def _route_catalog(spark, sf_dir):
    ids = lambda c: joined(F.transform(c, lambda s: s["id"]))
    return route_catalog(spark, sf_dir).select(
        "route", "name", ids("frequencies").alias("frequencies"), ids("facets").alias("facets"),
        joined(F.transform("data_columns", lambda s: F.concat(
            s["id"], F.lit("="), F.coalesce(s["unit"], F.lit(""))))).alias("data_columns"),
        joined(F.col("child_routes")).alias("child_routes"))


@register("validate_requests", """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 2500 AS part, (SELECT count(*) FROM part) AS n FROM orders)
SELECT k AS request_id, concat_ws('|', CASE WHEN part >= n THEN 'unknown route' END,
  CASE WHEN part < n AND k % 4 = 3 THEN 'unsupported frequency' END,
  CASE WHEN part < n AND k % 3 <> part % 3 THEN 'unsupported columns: price' || k % 3 END,
  CASE WHEN part < n AND k % 5 = 1 THEN 'unsupported facets: fuel' END,
  CASE WHEN k % 6 = 2 THEN 'negative offset' END, CASE WHEN k % 7 = 4 THEN 'page length out of range' END,
  CASE WHEN k % 8 = 5 THEN 'unsupported sort direction' END) AS errors FROM r""")
def _validate_requests(spark, sf_dir):
    k = F.col("o_orderkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    requests = table(spark, sf_dir, "orders").select(
        k.alias("request_id"), F.concat(F.lit("parts/"), mod(2500).cast("string")).alias("route"),
        F.when(mod(4) == 3, "daily").otherwise("hourly").alias("frequency"),
        F.array(F.lit("value"), F.concat(F.lit("price"), mod(3).cast("string"))).alias("data_columns"),
        F.when(mod(5) == 1, F.array(F.lit("fuel"))).otherwise(F.array(F.lit("respondent"))).alias("facets"),
        F.when(mod(6) == 2, -1).otherwise(0).alias("offset"), F.when(mod(7) == 4, 5001).otherwise(5000).alias("length"),
        F.when(mod(8) == 5, F.array(F.lit("up"))).otherwise(F.array(F.lit("ASC"), F.lit("desc"))).alias("sort_directions"))
    return validate_requests(requests, route_catalog(spark, sf_dir)).select("request_id", joined(F.col("errors")).alias("errors"))


# ---- reactor reports, one per customer ----------------------------------------------------
#: Reports parsed by a task.
REPORTS = 10_000
REPORT = ('<title>x</title><h2>Power Reactor Status</h2><h3 class="r">NRC Region 1</h3><table><tr><th>Unit</th><th>Power</th></tr>'
          '<tr><td>Plant {k} &amp; Co 1</td><td>100</td></tr><tr><td>Palo Verde 2</td><td> {p} %</td></tr></table><h4>Notes</h4>'
          '<H3>Region {r}</H3><table><tr><td><b>Diablo</b> Canyon 1</td><td>{q}</td></tr><tr><td>only</td></tr>'
          '<tr><td>Bad</td><td>999</td></tr><tr><td>Diablo Canyon 2</td><td>{z}</td></tr><tr><td>None</td><td>n/a</td></tr></table>')
REPORT_TEXT = "Header\nNRC Region 1\nUnit | Power\nPlant {k}  1 | 100\r\nPalo Verde 2 | {p}\n\nDiablo Canyon 1\nRegion {r}\nDiablo  Canyon 1|{q}\nBad | 999\nDiablo Canyon 2 | {z}"
UNIT_SQL = """rep AS (SELECT c_custkey AS k, c_custkey % 90 + 5 AS p, c_custkey % 4 + 1 AS r, CASE WHEN c_custkey % 5 = 0 THEN 0 WHEN c_custkey % 2 = 0 THEN 100 ELSE 97 END AS q,
   CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 100 END AS z, DATE '2024-01-01' + CAST(c_custkey % 365 AS INTEGER) AS report_date FROM customer),
units AS (SELECT k, report_date, 0 AS ord, 'Plant ' || k || ' & Co 1' AS unit_name, 100 AS power_percent, 1 AS region FROM rep
  UNION ALL SELECT k, report_date, 1, 'Palo Verde 2', p, 1 FROM rep UNION ALL SELECT k, report_date, 2, 'Diablo Canyon 1', q, r FROM rep
  UNION ALL SELECT k, report_date, 3, 'Diablo Canyon 2', z, r FROM rep)"""


def report_columns(spark, sf_dir):
    k = F.col("c_custkey")
    mod = lambda n: F.pmod(k, F.lit(n))
    values = {"k": k, "p": mod(90) + 5, "r": mod(4) + 1,
              "q": F.when(mod(5) == 0, 0).when(mod(2) == 0, 100).otherwise(97), "z": F.when(mod(5) == 0, 0).otherwise(100)}
    return spread_table(spark, sf_dir, "customer", "c_custkey", rows=REPORTS).select(
        k.alias("page_id"), fill(REPORT, **values).alias("html"), fill(REPORT_TEXT, **values).alias("text"),
        F.date_add(F.lit("2024-01-01").cast("date"), mod(365).cast("int")).alias("report_date"))


def report_units(spark, sf_dir):
    reports = report_columns(spark, sf_dir)
    return parse_reactor_tables(reports).join(reports.select("page_id", "report_date"), "page_id")


@register("parse_reactor_tables", f"WITH {UNIT_SQL} SELECT k AS page_id, unit_name, power_percent, region FROM units")
def _reactor_tables(spark, sf_dir):
    return parse_reactor_tables(report_columns(spark, sf_dir)).select("page_id", "unit_name", "power_percent", "region")


@register("parse_reactor_lines", f"WITH {UNIT_SQL} SELECT k AS page_id, replace(unit_name, ' & Co', '') AS unit_name, power_percent, region FROM units")
def _reactor_lines(spark, sf_dir):
    return parse_reactor_lines(report_columns(spark, sf_dir)).select("page_id", "unit_name", "power_percent", "region")


@register("match_plants", f"""WITH {UNIT_SQL}, asks AS (SELECT n_nationkey, {sql_nth(('Diablo Canyon', 'palo-verde 2', 'Plant 7', 'Verde', 'Unknown'), 'n_nationkey')} AS plant_query FROM nation),
t AS (SELECT n_nationkey, plant_query, u.k, u.unit_name, lower(unit_name) = lower(replace(plant_query, '-', ' ')) AS exact_name
   FROM asks JOIN (SELECT * FROM units WHERE k = (SELECT arg_max(k, (report_date, k)) FROM units)) u ON contains(trim(regexp_replace(lower(unit_name), '[^a-z0-9]+', ' ', 'g')), lower(replace(plant_query, '-', ' ')))),
b AS (SELECT *, bool_or(exact_name) OVER (PARTITION BY n_nationkey) AS any_exact FROM t)
SELECT n_nationkey, k AS page_id, unit_name, CASE WHEN exact_name THEN 1 ELSE 2 END AS tier FROM b WHERE exact_name = any_exact""")
def _match_plants(spark, sf_dir):
    asks = table(spark, sf_dir, "nation").select("n_nationkey", nth(
        ("Diablo Canyon", "palo-verde 2", "Plant 7", "Verde", "Unknown"), F.col("n_nationkey")).alias("plant_query"))
    return match_plants(asks, newest_units(report_columns(spark, sf_dir))).select(
        "n_nationkey", "page_id", "unit_name", "tier")


PLANT_SQL = f"""{UNIT_SQL}, plants AS (SELECT *, regexp_replace(unit_name, ' [0-9]+$', '') AS plant FROM units)"""


def with_plants(units):
    """Every unit under the query that names its plant: the unit's name without its number."""
    return units.withColumn("plant_query", F.regexp_replace("unit_name", " [0-9]+$", ""))


@register("plant_status", f"""WITH {PLANT_SQL}
SELECT k AS page_id, plant AS plant_query, CASE WHEN min(power_percent) >= 100 THEN 'full' WHEN max(power_percent) = 0 THEN 'offline' ELSE 'reduced' END AS plant_state,
  string_agg(unit_name || ': ' || power_percent || '%', ', ' ORDER BY ord) AS unit_summary,
  CASE WHEN min(power_percent) >= 100 THEN 'Yes. ' || plant || ' was reported at full power in the latest NRC status report.'
       WHEN max(power_percent) = 0 THEN 'No. ' || plant || ' was reported offline in the latest NRC status report.'
       ELSE 'No. ' || plant || ' was not operating at full power in the latest NRC status report.' END AS direct_answer
FROM plants GROUP BY k, plant""")
def _plant_status(spark, sf_dir):
    out = plant_status(with_plants(parse_reactor_tables(report_columns(spark, sf_dir))), ("page_id",))
    return out.select("page_id", "plant_query", "plant_state", "unit_summary", "direct_answer")


@register("reactor_records", f"""WITH {PLANT_SQL}
SELECT DISTINCT k AS page_id, plant, 'nrc_reactor_status' AS provider_id, strftime(report_date, '%Y-%m-%dT08:00:00+00:00') AS observed_text,
  'percent of rated power' AS unit, true AS complete_coverage, CAST(NULL AS BOOLEAN) AS calculation_verified FROM plants""")
def _reactor_records(spark, sf_dir):
    out = plant_status(with_plants(report_units(spark, sf_dir)), ("page_id", "report_date"))
    recs = observed_text(reactor_records(out, ("page_id", "plant_query")))
    return recs.select("page_id", F.col("plant_query").alias("plant"), "provider_id", "observed_text", "payload.unit", "flags.complete_coverage",
                       "flags.calculation_verified")


REACTOR_ANSWER_SQL = f"""{UNIT_SQL}, last_units AS (SELECT * FROM units WHERE k = (SELECT arg_max(k, (report_date, k)) FROM units)),
plants AS (SELECT plant, min(power_percent) AS lo, max(power_percent) AS hi, string_agg(unit_name || ': ' || power_percent || '%', ', ' ORDER BY ord, unit_name, power_percent) AS listing
   FROM last_units JOIN (VALUES ('Diablo Canyon'), ('Palo Verde')) p(plant) ON contains(unit_name, plant) GROUP BY plant),
rq AS (SELECT question_id, CASE WHEN contains(' ' || trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g')) || ' ', ' diablo canyon ') THEN 'Diablo Canyon'
   WHEN contains(lower(question), 'diablo canyon') THEN 'Diablo Canyon' WHEN contains(lower(question), 'palo verde') THEN 'Palo Verde' END AS plant FROM questions),
reactor_answers AS (SELECT question_id, plant, CASE WHEN plant IS NULL THEN 'needs_clarification' WHEN lo IS NULL THEN 'held' ELSE 'answered' END AS status,
  CASE WHEN lo IS NULL THEN 'insufficient' ELSE 'high' END AS confidence,
  CASE WHEN plant IS NULL THEN 'Please specify the nuclear plant or reactor unit.'
    WHEN lo >= 100 THEN 'Yes. ' || plant || ' was reported at full power in the latest NRC status report.'
    WHEN hi = 0 THEN 'No. ' || plant || ' was reported offline in the latest NRC status report.'
    ELSE 'No. ' || plant || ' was not operating at full power in the latest NRC status report.' END AS direct_answer, listing
  FROM rq LEFT JOIN plants USING (plant))"""


@register("answer_reactors", f"""WITH {QUESTIONS_SQL}, {REACTOR_ANSWER_SQL}
SELECT question_id, status, confidence, direct_answer,
  'The NRC listed ' || listing || '. These values represent reported reactor power as a percentage of rated power.' AS simple_explanation FROM reactor_answers""")
def _answer_reactors(spark, sf_dir):
    out = answer_reactors(questions(spark, sf_dir), report_columns(spark, sf_dir))
    return out.select("question_id", "status", "confidence", "direct_answer", "simple_explanation")


@register("plant_query", f"WITH {QUESTIONS_SQL}, {REACTOR_ANSWER_SQL} SELECT question_id, plant AS plant_query FROM rq")
def _plant_query(spark, sf_dir):
    return questions(spark, sf_dir).select("question_id", plant_query(F.col("question")).alias("plant_query"))


@register("latest_report", f"WITH {UNIT_SQL} SELECT k AS page_id, unit_name FROM units WHERE k = (SELECT arg_max(k, (report_date, k)) FROM units)")
def _latest_report(spark, sf_dir):
    return latest_report(report_units(spark, sf_dir)).select("page_id", "unit_name")


# ---- search payloads of pages, logged responses of conversations ---------------------------
TITLE = "(?s)<title>(.*?)</title>"
HOST = "^https?://([^/]+)"


def strip_sql(c):
    return f"regexp_replace({c}, '^{SP}+|{SP}+$', '', 'g')"


def listed_json(rows, key, order, items):
    """One JSON array for each key: a row's ``items`` (an array of structs), rows in order."""
    gathered = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, items.alias("items")))), lambda x: x["items"]))
    return rows.groupBy(key).agg(gathered.alias("items"))


PAGE_SQL = f"""p AS (SELECT *, regexp_extract(html, '{TITLE}', 1) AS title, regexp_extract(url, '{HOST}', 1) AS domain FROM pages)"""


@register("normalize_news", f"""WITH {PAGE_SQL},
a AS (SELECT *, page_id // 8 AS query_id, row_number() OVER (PARTITION BY page_id // 8 ORDER BY page_id) - 1 AS pos FROM p)
SELECT query_id, pos, {strip_sql('title')} AS title, url, domain, CASE WHEN page_id % 3 > 0 THEN '20240101T' || page_id END AS published_at FROM a
WHERE page_id % 7 <> 6 AND {strip_sql('title')} <> ''""")
def _news(spark, sf_dir):
    i = F.col("page_id")
    article = F.struct(
        F.when(i % 7 == 6, " ").otherwise(F.concat(F.lit(" "), F.regexp_extract("html", TITLE, 1), F.lit("\n"))).alias("title"),
        F.col("url"), F.regexp_extract("url", HOST, 1).alias("domain"),
        F.when(i % 3 > 0, F.concat(F.lit("20240101T"), i.cast("string"))).otherwise(" ").alias("seendate"), F.lit("English").alias("language"))
    rows = table(spark, sf_dir, "pages").withColumn("query_id", F.expr("page_id div 8"))
    payloads = listed_json(rows, "query_id", i, F.array(article)).select("query_id", F.to_json(F.struct(F.col("items").alias("articles"))).alias("body"))
    return normalize_news(payloads).select("query_id", "pos", "title", "url", "domain", "published_at")


@register("normalize_web_results", f"""WITH {PAGE_SQL},
a AS (SELECT *, page_id // 20 AS query_id, 'https://' || domain || '/' AS site FROM p)
SELECT query_id, site AS url, {strip_sql('title')} AS title, {strip_sql('left(html, 300)')} AS snippet, CASE WHEN page_id % 4 > 0 THEN '2024-01-0' || page_id % 4 END AS published_at,
  CASE WHEN page_id % 5 = 0 THEN 'engine' END AS source_engine
FROM a WHERE {strip_sql('title')} <> '' QUALIFY row_number() OVER (PARTITION BY query_id, site ORDER BY page_id) = 1""")
def _web_results(spark, sf_dir):
    i = F.col("page_id")
    even = F.pmod(i, F.lit(2)) == 0
    site, text = F.concat(F.lit("https://"), F.regexp_extract("url", HOST, 1), F.lit("/")), F.substring("html", 1, 300)
    item = F.struct(  # either spelling of the link and of the snippet
        F.regexp_extract("html", TITLE, 1).alias("title"), F.when(even, site).alias("href"), F.when(~even, site).alias("url"),
        F.when(even, text).alias("body"), F.when(~even, text).alias("description"),
        F.when(i % 4 > 0, F.concat(F.lit("2024-01-0"), (i % 4).cast("string"))).alias("date"), F.when(i % 5 == 0, "engine").alias("source"))
    rows = table(spark, sf_dir, "pages").withColumn("query_id", F.expr("page_id div 20"))
    payloads = listed_json(rows, "query_id", i, F.array(item)).select("query_id", F.to_json("items").alias("body"))
    return normalize_web_results(payloads).select("query_id", "url", "title", "snippet", "published_at", "source_engine")


def response_log(spark, sf_dir):
    """One logged response for each conversation: its answers are output texts with notes, its questions consulted sources."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    place = F.pmod(F.length("text"), F.lit(5)).cast("string")
    answer = F.col("role") == "assistant"
    note = F.struct(F.lit("url_citation").alias("type"), F.concat(F.lit("https://c.org/"), place).alias("url"), F.substring("text", 1, 40).alias("title"))
    other = F.struct(F.lit("file").alias("type"), F.lit("").alias("url"), F.lit("").alias("title"))
    part = F.struct(F.when(answer, "output_text").otherwise("refusal").alias("type"), F.col("text"), F.array(note, other, note).alias("annotations"))
    source = F.struct(F.when(F.col("role") == "system", "").otherwise(F.concat(F.lit("https://s.org/"), place)).alias("url"),
                      F.substring("text", 1, 30).alias("title"), F.col("role").alias("type"))
    order = F.col("turn")
    parts = listed_json(turns, "conv_id", order, F.array(part)).withColumnRenamed("items", "content")
    sources = listed_json(turns.where(~answer), "conv_id", order, F.array(source)).withColumnRenamed("items", "sources")
    output = F.concat(
        F.lit('{"output":[{"type":"web_search_call","action":{"sources":'), F.coalesce(F.to_json("sources"), F.lit("[]")),
        F.lit('}},{"type":"reasoning"},{"type":"message","content":'), F.to_json("content"), F.lit("}]}"))
    return parts.join(sources, "conv_id", "left").select(F.col("conv_id").alias("response_id"), output.alias("body"))


TURN_SQL = "t AS (SELECT conv_id AS response_id, turn, role, coalesce(text, '') AS text FROM conversations)"


@register("response_answers", f"""WITH {TURN_SQL}
SELECT response_id, {strip_sql("coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')")} AS answer FROM t GROUP BY response_id""")
def _response_answers(spark, sf_dir):
    return response_answers(response_log(spark, sf_dir))


@register("response_citations", f"""WITH {TURN_SQL}, c AS (SELECT *, 'https://c.org/' || length(text) % 5 AS url FROM t WHERE role = 'assistant')
SELECT response_id, url, coalesce(nullif(left(text, 40), ''), url) AS title FROM c QUALIFY row_number() OVER (PARTITION BY response_id, url ORDER BY turn) = 1""")
def _response_citations(spark, sf_dir):
    return response_citations(response_log(spark, sf_dir)).select("response_id", "url", "title")


@register("response_sources", f"""WITH {TURN_SQL}, c AS (SELECT *, 'https://s.org/' || length(text) % 5 AS url FROM t WHERE role NOT IN ('assistant', 'system'))
SELECT response_id, url, coalesce(nullif(left(text, 30), ''), url) AS title, role AS source_type FROM c QUALIFY row_number() OVER (PARTITION BY response_id, url ORDER BY turn) = 1""")
def _response_sources(spark, sf_dir):
    return response_sources(response_log(spark, sf_dir)).select("response_id", "url", "title", "source_type")
