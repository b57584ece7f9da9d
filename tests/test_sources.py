"""Series files, manifests, API pages, reactor reports and pages."""
from __future__ import annotations

import json
import zipfile

from pyspark.sql import functions as F

from gridledger.operators.joins import validate_requests
from gridledger.operators.reactors import plant_status
from gridledger.operators.series import latest_observations
from gridledger.plans.series import answer_operating
from gridledger.sources.api_pages import api_page_status, explode_api_pages, parse_route_catalog
from gridledger.sources.bulk import flatten_bulk_manifest, resolve_bulk_files, search_bulk_files
from gridledger.sources.reactors import parse_reactor_lines, parse_reactor_tables
from gridledger.sources.series import SeriesArchiveReader, parse_series_lines, read_series_archives, read_series_lines
from gridledger.sources.web import extract_page_blocks, extract_page_text

LOAD = {"series_id": "EBA.PJM-ALL.D.H", "name": "Load of the zone", "unitsshort": "MWh", "f": "h",
        "data": [["20240511T23Z", "88345.5"], ["20240511T22Z", " N/A "], ["20240511T21Z", "87110"], ["20240511T20Z", "86002"]]}


def lines(spark, *items):
    rows = [("f", 0, i, item if isinstance(item, str) else json.dumps(item)) for i, item in enumerate(items)]
    return spark.createDataFrame(rows, "file string, block long, row long, line string")


def test_series_latest_skips_null_words(spark):
    row = latest_observations(parse_series_lines(lines(spark, {"category_id": 1}, "", LOAD))).collect()[0]
    assert (row.observation_count, row.latest_value, row.unit) == (3, 88345.5, "MWh")
    assert str(row.latest_ts) == "2024-05-11 23:00:00"


def test_series_faults_and_first_record(spark):
    other = dict(LOAD, data=[["20240601T00Z", 1]])
    assert latest_observations(parse_series_lines(lines(spark, LOAD, other))).collect()[0].latest_value == 88345.5
    for change, reason in (({"unitsshort": " "}, "no_unit"), ({"f": "M"}, "not_hourly"), ({"data": "x"}, "no_data_array"),
                           ({"data": [["20240511T06Z", "--"]]}, "no_observations"),
                           ({"data": [["when", 3], ["20240511T06Z", 1]]}, "unsupported_period"),
                           ({"data": [["when", None], ["20240511T06Z", 1]]}, None)):
        row = latest_observations(parse_series_lines(lines(spark, dict(LOAD, **change)))).collect()[0]
        assert row.source_reject == reason
    object_items = dict(LOAD, data=[{"timestamp": "2024-05-11T06:00:00Z", "value": 5}, {"period": "2024-05-11T06", "value": "6"}])
    row = latest_observations(parse_series_lines(lines(spark, object_items))).collect()[0]
    assert (row.observation_count, row.latest_value) == (1, 6.0)


def test_series_files_plain_and_zipped(spark, tmp_path):
    body = "\n".join(["{broken", json.dumps({"category_id": 1}), json.dumps(LOAD)])
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "eba.txt").write_text(body)
    (tmp_path / "zipped").mkdir()
    with zipfile.ZipFile(tmp_path / "zipped" / "eba.zip", "w") as z:
        z.writestr("EBA.txt", "\ufeff" + body)
    for read, folder in ((read_series_lines, "plain"), (read_series_archives, "zipped")):
        series = parse_series_lines(read(spark, str(tmp_path / folder)))
        assert sorted(r.reject_reason or "ok" for r in series.collect()) == ["malformed_json", "no_series_id", "ok"]
        assert latest_observations(series).collect()[0].latest_value == 88345.5


def test_operating_answers(spark):
    asked = spark.createDataFrame(
        [(1, "PJM demand now", "2024-05-12 04:30:00"), (2, "pjm load", "2024-05-20 04:30:00"),
         (3, "MISO demand", "2024-05-12 04:30:00"), (4, "demand somewhere", "2024-05-12 04:30:00")],
        "question_id int, question string, at string").withColumn("as_of", F.col("at").cast("timestamp"))
    got = {r.question_id: r for r in answer_operating(asked, parse_series_lines(lines(spark, LOAD))).collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["answered", "stale", "held", "needs_clarification"]
    assert [got[i].confidence for i in (1, 2, 3)] == ["high", "medium", "insufficient"]
    assert got[1].direct_answer == ("EIA reported PJM demand of 88,346 MWh for the hourly interval"
                                    " ending 2024-05-11T23:00:00+00:00.")
    assert got[1].equivalent_mw == 88345.5 and got[1].age_hours == 5.5
    assert got[4].direct_answer == "Please specify the balancing authority."


def manifests(spark, *bodies):
    rows = [(i, json.dumps(b)) for i, b in enumerate(bodies)]
    return flatten_bulk_manifest(spark.createDataFrame(rows, "manifest_id int, body string"))


def test_manifest_envelopes(spark):
    entry = {"identifier": "EBA", "data_set": "EBA", "title": "Operating data", "download_url": "https://api.eia.gov/bulk/EBA.zip"}
    found = manifests(spark, {"files": [entry]}, [entry, entry], {"x": {"y": {"manifest": [entry]}}},
                      {"NG": {"name": "Gas", "url": "http://www.eia.gov/NG.zip"}}, {"files": [dict(entry, download_url="https://evil.org/a.zip")]})
    files = {r.manifest_id: r for r in resolve_bulk_files(found).collect()}
    assert [files[i].identifier for i in range(4)] == ["EBA", "EBA", "EBA", "NG"]
    assert files[3].download_url == "https://www.eia.gov/NG.zip"
    assert files[4].reject_reason == "unapproved_host" and files[0].reject_reason is None
    assert found.where("manifest_id = 1").count() == 1
    assert search_bulk_files(resolve_bulk_files(found), ("operating", "eba")).count() == 4


def test_manifest_nested_to_any_depth(spark):
    body = {"id": "a", "title": "t"}
    for n in range(12):
        body = {"level": body} if n % 3 else [body]
    assert [r.raw["id"] for r in manifests(spark, body).collect()] == ["a"]


def test_damaged_series_archives_become_rejected_lines(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.txt", json.dumps(LOAD).encode() + b"\n\xff\xfe{}\n")
        z.writestr("b.json", b"STORED " * 50)
    whole = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "b.zip").write_bytes(whole.replace(b"STORED ", b"BROKEN "))
    (tmp_path / "c.zip").write_bytes(b"no archive")
    series = parse_series_lines(read_series_archives(spark, str(tmp_path)))
    assert sorted(r.reject_reason or "ok" for r in series.collect()) == ["malformed_json"] * 5 + ["ok"] * 2
    assert sorted(r.row for r in series.where("reject_reason is not null").collect()) == [-1, -1, 0, 1, 1]


def test_large_series_archives_are_dealt_by_members(spark, tmp_path):
    """Members are ranges of a large archive; lines keep the order of member and line, long ones included."""
    long = json.dumps(dict(LOAD, name="n" * 3_000_000))
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for m in range(40):
            body = "\n".join([json.dumps(dict(LOAD, series_id=f"S{m}-{i}")) for i in range(m % 3 * 60)] + ([long] if m == 7 else []))
            z.writestr(f"{m}.jsonl" if m % 10 else f"{m}.md", body + "\n" * (m % 2))
    reader = SeriesArchiveReader({"path": str(tmp_path), "split": "30000"})
    parts = [p for part in reader.partitions() for p in part.value]
    assert len(parts) > 10 and [a for _, a, _ in parts[1:]] == [b for _, _, b in parts[:-1]] and parts[-1][2] is None
    at_once = [(r["block"], r["row"], r["line"]) for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist() if r["line"]]
    members = [m for m in range(40) if m % 10]
    want = [(block, i, json.loads(line)["series_id"]) for block, m in enumerate(members)
            for i, line in enumerate([json.dumps({"series_id": f"S{m}-{i}"}) for i in range(m % 3 * 60)] + ([long] if m == 7 else []))]
    assert sorted((b, r, json.loads(x)["series_id"]) for b, r, x in at_once) == want
    got = read_series_archives(spark, str(tmp_path), str(tmp_path / "landed")).where("line <> ''").collect()
    assert sorted((r.block, r.row, json.loads(r.line)["series_id"]) for r in got) == want


def test_api_pages(spark):
    pages = spark.createDataFrame([
        (1, '{"response":{"total":"9","data":[{"period":"2026","value":1.5},3]}}'), (2, '{"error":"no key"}'),
        (3, '{"data":[]}'), (4, "nope")], "page_id int, body string")
    got = {r.page_id: r for r in api_page_status(pages).collect()}
    assert (got[1].reject_reason, got[1].row_count, got[1].total) == (None, 1, 9)
    assert [got[i].reject_reason for i in (2, 3, 4)] == ["source_error: no key", "missing_response", "invalid_json"]
    assert api_page_status(pages, strict_rows=True).where("page_id = 1").first().reject_reason == "non_object_row"
    assert explode_api_pages(pages, ("page_id",)).first().fields["period"] == "2026"


def test_route_metadata_and_requests(spark):
    body = json.dumps({"response": {"id": "r", "frequency": [{"id": "hourly"}], "facets": [{"id": "respondent"}],
                                    "data": [{"id": "value", "unit": "MWh"}, {"id": " "}], "routes": [{"id": "c"}]}})
    catalog = parse_route_catalog(spark.createDataFrame([("/v2/electricity/rto/", body)], "route string, body string"))
    request = ("electricity/rto", "hourly", ["value"], ["respondent"], 0, 5000, ["asc"])
    rows = [request, request[:2] + (["value", "price"],) + request[3:], request[:1] + ("monthly", ["value"], ["fuel"], -1, 0, ["up"])]
    asked = spark.createDataFrame(rows, "route string, frequency string, data_columns array<string>, facets array<string>,"
                                        " offset int, length int, sort_directions array<string>")
    got = sorted(len(r.errors) for r in validate_requests(asked, catalog).collect())
    assert got == [0, 1, 5]


HTML = ("<h2>Status</h2><h3>Region 2</h3><table><thead><tr><th>Unit</th><th>Power</th></tr></thead><tr><td> Elm Creek 3 </td><td>64 %</td></tr>"
        "<tr><td>Elm Creek 4</td><td>0</td></tr></table><h3>Region 3</h3><table><tr><td>North Ford 2</td><td>100</td></tr></table>")


def test_reactor_pages(spark):
    pages = spark.createDataFrame([(1, HTML, "NRC Region 2\nElm Creek 3 | 64\nElm Creek 4\nRegion 3\nNorth Ford 2 | 100")],
                                  "page_id int, html string, text string")
    units = parse_reactor_tables(pages)
    assert [(r.unit_name, r.power_percent, r.region) for r in units.orderBy("pos").collect()] == [
        ("Elm Creek 3", 64, 2), ("Elm Creek 4", 0, 2), ("North Ford 2", 100, 3)]
    # a unit number is never a power figure
    assert [r.unit_name for r in parse_reactor_lines(pages).orderBy("pos").collect()] == ["Elm Creek 3", "North Ford 2"]
    plants = units.where("unit_name like 'Elm%'").withColumn("plant_query", F.lit("Elm Creek"))
    row = plant_status(plants, ("page_id",)).first()
    assert row.direct_answer.startswith("No. Elm Creek was not operating at full power")
    assert row.unit_summary == "Elm Creek 3: 64%, Elm Creek 4: 0%"


def test_page_extractors(spark):
    long = "word " * 30
    html = (f"<html><title> A &amp; B </title><script>var x='<p>no</p>'</script><p>One&nbsp;&#233; <b>two</b></p>"
            f"<div>{long}</div><span>short</span></html>")
    pages = spark.createDataFrame([(1, html), (2, "<p>tiny</p>")], "page_id int, html string")
    got = {r.page_id: r for r in extract_page_text(pages).collect()}
    assert got[1].title == "A & B" and got[1].reject_reason is None
    assert got[1].text.split("\n")[1] == "One\xa0é two"
    assert "no" not in got[1].text.split() and got[2].reject_reason == "insufficient_text"
    blocks = {r.page_id: r for r in extract_page_blocks(pages).collect()}
    assert "short" not in blocks[1].text and long.strip() in blocks[1].text


def test_hidden_tags_in_any_order(spark):
    cases = [("<p>a</p><script>x <p>b</p>", "", "a"), ("<svg><svg>x</svg>y</svg>z", "", "z"), ("</svg>a<svg>b</svg>c", "", "a c"),
             ("<template>t<noscript>n</template>m</noscript>d", "", "d"), ("a<svg/>b", "", "a b"),
             ("<svg><script>if (a</svg>b) x</script>y</svg>z", "", "z"), ("a<!-- <svg> -->b", "", "a b"), ("a<!-- never", "", "a"),
             ("<svg><title>no</title></svg><title>yes</title><p>x", "yes", "yes\nx"), ("<title>t <b>u", "t u", "t u"),
             ("<STYLE>p{}</style >a<Canvas x='1'>b", "", "a"), ("a<div><p>b</div>c</p>d", "", "a\nb\nc\nd"), ("", "", ""), (None, None, None)]
    pages = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id int, html string")
    got = {r.page_id: r for r in extract_page_text(pages, min_chars=0).collect()}
    assert [(got[i].title, got[i].text) for i in range(len(cases))] == [c[1:] for c in cases]
