"""Work on large tables of one row group: spread over tasks, done once."""
from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq

from gridledger.plans.prices import answer_prices
from gridledger.plans.reactors import latest_report
from gridledger.queries import base, ingest, prices

FOLDER = "/root/testdata/sf0.001"


def tasks(df):
    return df.rdd.getNumPartitions()


def test_archives_of_one_row_group_are_made_by_many_tasks(spark, tmp_path):
    keys = list(range(3 * ingest.ARCHIVES))
    pq.write_table(pa.table({"c_custkey": keys, "c_acctbal": [1.0] * len(keys), "c_name": ["n"] * len(keys)}), tmp_path / "customer.parquet")
    assert tasks(base.table(spark, str(tmp_path), "customer")) == 1
    assert tasks(ingest.archive_files(spark, str(tmp_path))) == 3


def test_reports_manifests_and_questions_are_spread(spark, tmp_path, monkeypatch):
    keys = list(range(60_000))
    pq.write_table(pa.table({"c_custkey": keys}), tmp_path / "customer.parquet")
    pq.write_table(pa.table({"p_partkey": keys, "p_name": ["n"] * len(keys)}), tmp_path / "part.parquet")
    pq.write_table(pa.table({"o_orderkey": list(range(250_000)), "o_custkey": [1] * 250_000}), tmp_path / "orders.parquet")
    assert tasks(ingest.report_columns(spark, str(tmp_path))) == 60_000 / ingest.REPORTS
    assert tasks(prices.price_questions(spark, str(tmp_path))) == 3
    seen = []
    monkeypatch.setattr(ingest, "flatten_bulk_manifest", seen.append)
    ingest.manifest_records(spark, str(tmp_path))
    assert tasks(seen[0]) == 3


def test_newest_report_parses_its_units_once(spark):
    plan = latest_report(ingest.report_units(spark, FOLDER))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1
    units = spark.sql("""select * from values (1, date'2024-01-01', 'a'), (2, date'2024-01-02', 'b'), (3, date'2024-01-02', 'c'),
      (3, date'2024-01-02', 'd'), (4, null, 'e'), (null, date'2024-01-03', 'f') u(page_id, report_date, unit_name)""")
    assert sorted(r.unit_name for r in latest_report(units).collect()) == ["c", "d"]


def test_price_questions_are_resolved_once_for_their_answers(spark):
    questions, rows = prices.price_questions(spark, FOLDER), prices.filed_hourly(spark, FOLDER)
    out = answer_prices(questions, rows, file="file")
    assert _reads(out, "o_custkey") == 1
    apart = answer_prices(questions, rows, file="file", broadcast_days=0)
    assert sorted(map(str, out.select(sorted(out.columns)).collect())) == sorted(map(str, apart.select(sorted(out.columns)).collect()))


def _reads(df, column):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum("Relation" in line and column in line for line in plan.splitlines())
