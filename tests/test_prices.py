"""Price rows, windows, coverage and price questions on hand-built days."""
from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from gridledger.functions.times import day_end_utc, day_start_utc, expected_intervals
from gridledger.operators.prices import PriceDays, price_day_summary, summarize_prices
from gridledger.plans.prices import answer_prices, resolve_price_questions
from gridledger.sources.prices import (
    ArchiveLimits,
    detect_price_errors, normalize_price_rows, price_archive_rows, read_price_archives,
    typed_price_rows)

NP15 = "TH_NP15_GEN-APND"


def day_rows(hours=24, start="2026-08-02 07:00:00", node=NP15, component="LMP", price=None):
    from datetime import datetime, timedelta

    first = datetime.fromisoformat(start)
    return [(f"{first + timedelta(hours=h):%Y-%m-%dT%H:%M:%S}-00:00",
             f"{first + timedelta(hours=h + 1):%Y-%m-%dT%H:%M:%S}-00:00", node, "DAM", component,
             str(price if price is not None else 20 + h)) for h in range(hours)]


COLUMNS = ["INTERVALSTARTTIME_GMT", "INTERVALENDTIME_GMT", "NODE_ID_XML", "MARKET_RUN_ID", "LMP_TYPE", "MW"]


def typed(spark, rows):
    return typed_price_rows(normalize_price_rows(spark.createDataFrame(rows, COLUMNS)))


def only(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_full_day(spark):
    row = only(price_day_summary(typed(spark, day_rows())))
    assert (row.coverage, row.actual_count, row.expected_count) == ("complete", 24, 24)
    assert (row.average_price, row.minimum_price, row.maximum_price) == (31.5, 20.0, 43.0)
    assert str(row.market_date) == "2026-08-02"
    assert str(row.minimum_start) == "2026-08-02 07:00:00"


def test_incomplete_duplicate_and_other_rows(spark):
    assert only(price_day_summary(typed(spark, day_rows(23)))).coverage == "incomplete"
    rows = day_rows()
    assert only(price_day_summary(typed(spark, rows + rows[-1:]))).coverage == "duplicate"
    mixed = day_rows() + day_rows(component="MCC") + day_rows(node="TH_SP15_GEN-APND")
    assert {r.location: r.coverage for r in price_day_summary(typed(spark, mixed)).collect()} == {
        NP15: "complete", "TH_SP15_GEN-APND": "complete"}


def test_faulty_rows_fault_the_day(spark):
    bad_price = day_rows(23) + [day_rows()[-1][:5] + ("NaN",)]
    assert only(price_day_summary(typed(spark, bad_price))).coverage == "invalid_price"
    last = day_rows()[-1]
    backwards = day_rows(23) + [(last[0], last[0]) + last[2:]]
    assert only(price_day_summary(typed(spark, backwards))).coverage == "invalid_interval"
    unplaced = day_rows() + [("when?",) + last[1:]]
    asked = spark.sql(f"select '{NP15}' location, 'DAM' market, date'2026-08-02' market_date")
    assert only(summarize_prices(typed(spark, unplaced), asked)).coverage == "invalid_timestamp"


def test_extremes_keep_the_earliest_interval(spark):
    row = only(price_day_summary(typed(spark, day_rows(price=5))))
    assert str(row.minimum_start) == str(row.maximum_start) == "2026-08-02 07:00:00"


def test_first_non_empty_alias_and_case(spark):
    rows = [r[:3] + ("", "dam") + r[4:] for r in day_rows()]
    columns = COLUMNS[:3] + ["market run id", "Market"] + COLUMNS[4:]
    wide = spark.createDataFrame(rows, columns)
    assert only(price_day_summary(typed_price_rows(normalize_price_rows(wide)))).market == "DAM"


def test_market_days_around_clock_changes(spark):
    days = spark.sql("select explode(array(date'2026-07-01', date'2026-03-08', date'2026-11-01')) as d")
    start, end = day_start_utc(F.col("d")), day_end_utc(F.col("d"))
    for market, counts in (("DAM", [24, 23, 25]), ("FMM", [96, 92, 100]), ("RTM", [288, 276, 300])):
        got = days.select("d", expected_intervals(start, end, F.lit(market)).alias("n")).collect()
        assert [r.n for r in got] == counts


def ask(spark, *texts, as_of="2026-08-03 05:00:00"):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "question_id int, question string").withColumn(
        "as_of", F.lit(as_of).cast("timestamp"))


def test_question_resolution(spark):
    texts = ["NP-15 day-ahead price yesterday", "sp15 real-time price on August 2, 2026", "zp26 fmm 2 Aug 2026",
             "NP15 15 minute price today", "NP15 price today", "NP15 and SP15 dam today", "np15 dam 2026-02-30",
             "np15 dam", "north path 15 dam 8/2/2026", " "]
    got = resolve_price_questions(ask(spark, *texts)).orderBy("question_id").collect()
    assert [r.status for r in got] == [
        "resolved", "resolved", "resolved", "ambiguous_market", "needs_clarification", "unsupported_location",
        "invalid_date", "missing_date", "resolved", "empty_question"]
    # 05:00 UTC on 3 August is still 2 August in the market zone
    assert [str(r.market_date) for r in got[:4]] == ["2026-08-01", "2026-08-02", "2026-08-02", "2026-08-02"]
    assert [r.market for r in got[:3]] == ["DAM", "RTM", "FMM"]


def test_answers(spark):
    out = answer_prices(ask(spark, "NP15 day ahead price on 2026-08-02", "SP15 dam 2026-08-02"),
                        typed(spark, day_rows())).orderBy("question_id").collect()
    assert out[0].status == "answered" and out[0].confidence == "high"
    assert out[0].direct_answer == "NP-15 DAM LMP averaged $31.50/MWh on 2026-08-02."
    assert out[1].status == "held" and out[1].confidence == "insufficient"


def filed(spark, rows):
    """Typed rows whose last value is their file."""
    wide = spark.createDataFrame(rows, [*COLUMNS, "file"])
    return typed_price_rows(normalize_price_rows(wide, keep=("file",)))


def test_rows_without_a_file_are_one_file(spark):
    nameless = day_rows() + [("2026-08-09T07:00:00-00:00", "2026-08-09T08:00:00-00:00", " ", "DAM", "MCC", "1")]
    assert only(price_day_summary(typed(spark, nameless))).coverage == "missing_location"


def test_landed_days_read_asked_folders_alone(spark, tmp_path):
    days = [f"2026-08-0{d}" for d in range(2, 8)]
    rows = [(*r, f"f{d}") for d in days for r in day_rows(start=f"{d} 07:00:00")]
    rows += [(*day_rows(1, start="2026-08-03 09:00:00", node="", component="MCC")[0], "f2026-08-04")]  # touches two days
    rows += [(*day_rows(1, start="2026-08-06 09:00:00", node=" ", component="MCC")[0], "other")]
    price_rows = filed(spark, rows)
    landed = PriceDays.land(price_rows, str(tmp_path), "file", parts=2)
    show = lambda df: sorted((r.location, str(r.market_date), r.coverage, r.actual_count, r.average_price) for r in df.collect())
    assert show(landed.summary()) == show(price_day_summary(price_rows, file="file"))
    asked = spark.createDataFrame([(NP15, "DAM", "2026-08-03"), (NP15, "DAM", "2026-08-04"), (NP15, "DAM", "2026-09-01"), (NP15, "DAM", None)],
                                  "location string, market string, day string")
    asked = asked.withColumn("market_date", F.to_date("day")).where("location is not null")
    summary = landed.summary(asked)
    assert [r[1:3] for r in show(summary)] == [("2026-08-03", "complete"), ("2026-08-04", "missing_location")]
    assert sorted(r._file for r in landed.refused(asked).collect()) == ["f2026-08-04"]
    assert sorted(r._file for r in landed.refused().collect()) == ["f2026-08-04", "other"]
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    out = answer_prices(ask(spark, "NP15 dam 2026-08-03", "NP15 dam 2026-08-04", "NP15 dam 2026-08-06"), landed).orderBy("question_id").collect()
    assert [r.status for r in out] == ["answered", "held", "answered"]


def test_a_row_of_no_day_faults_landed_days(spark, tmp_path):
    rows = [(*r, "f") for r in day_rows()] + [("when?", *day_rows()[-1][1:], "f")]
    landed = PriceDays.land(filed(spark, rows), str(tmp_path), "file")
    asked = spark.sql(f"select '{NP15}' location, 'DAM' market, date'2026-08-02' market_date")
    assert only(summarize_prices(landed, asked)).coverage == "invalid_timestamp"


def test_archive_files(spark, tmp_path):
    def archive(name, **members):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, text in members.items():
                z.writestr(member.replace("_", "."), text)

    lines = [",".join(COLUMNS)] + [",".join(r) for r in day_rows()]
    archive("good.zip", a_csv="\n".join(lines))
    archive("two.zip", a_csv="x", b_csv="y")
    archive("xml.zip", e_xml="<ERROR><ERR_DESC>No data\n returned</ERR_DESC></ERROR>")
    archive("none.zip", a_txt="x")
    (tmp_path / "bad.zip").write_bytes(b"<ERROR>refused</ERROR>")
    (tmp_path / "empty.zip").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "many.zip", "w") as z:
        for i in range(21):
            z.writestr(f"{i}.csv", "x")
    whole = (tmp_path / "two.zip").read_bytes()
    (tmp_path / "cut.zip").write_bytes(whole[:len(whole) // 2])
    archive("long.zip", a_csv="NODE,note\nx," + "y" * 200_000)
    stored = (tmp_path / "long.zip").read_bytes()
    (tmp_path / "crc.zip").write_bytes(stored.replace(b"yyyy", b"yyzy", 1))
    archive("blank.zip", a_csv="\n\n")
    rows = read_price_archives(spark, str(tmp_path)).cache()
    rejects = {r.path.rsplit("/", 1)[1]: r.reject_reason for r in rows.where("reject_reason is not null").collect()}
    assert rejects == {"two.zip": "multiple_csv", "xml.zip": "xml_only", "none.zip": "no_csv", "empty.zip": "empty_response",
                       "bad.zip": "bad_zip", "many.zip": "multiple_csv", "cut.zip": "bad_zip", "crc.zip": "corrupt_member", "blank.zip": "no_header"}
    assert rows.where("path like '%long.zip'").count() == 1
    limited = read_price_archives(spark, str(tmp_path), ArchiveLimits(max_members=20))
    assert limited.where("path like '%many.zip'").first().reject_reason == "too_many_members"
    empty = price_archive_rows(spark.sql("select 'e' path, cast('' as binary) content"))
    assert only(empty).reject_reason == "empty_response"
    row = only(price_day_summary(typed_price_rows(rows.where("path like '%good.zip'")), file="path"))
    assert row.average_price == 31.5 and row.coverage == "complete"
    errors = {r.path.rsplit("/", 1)[1]: r.message for r in detect_price_errors(rows).collect()}
    assert errors["xml.zip"] == "No data returned" and errors["bad.zip"] == "refused"
    assert errors["two.zip"] is None


def test_archive_records_stream_in_order(spark, tmp_path):
    """Quoted lines, short, long and blank records, a record longer than a block, two encodings, equal headers."""
    from gridledger.sources import landed
    wide = "y" * (2 * landed.CHUNK)
    text = ("\n node , LOCATION,Node,MW,opr dt\nfirst,a,\"two\nlines\",1.5,d\n\nx,b\n ,\u00e9 , ,3,d,too,many\n"
            + f"p,,q,4,{wide}\n" + "".join(f"n{i},,m{i},{i},d\n" for i in range(60_000)))
    for name, encoding in (("u.zip", "utf-8-sig"), ("w.zip", "windows-1252")):
        with zipfile.ZipFile(tmp_path / name, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.CSV", text.encode(encoding))
    got = read_price_archives(spark, str(tmp_path)).collect()
    for name in ("u.zip", "w.zip"):
        rows = sorted((r for r in got if r.path.endswith(name)), key=lambda r: r.row_no)
        assert [r.row_no for r in rows] == list(range(1, 60_005)) and all(r.reject_reason is None for r in rows)
        assert [(r.location, r.price, r.operating_date) for r in rows[:3]] == [("two\nlines", "1.5", "d"), ("b", None, None), ("\u00e9", "3", "d")]
        assert (rows[3].location, rows[3].price, rows[3].operating_date) == ("q", "4", wide)
        assert (rows[-1].location, rows[-1].price) == ("m59999", "59999")


def test_archives_are_dealt_by_size(spark, tmp_path):
    for i in range(12):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            z.writestr("a.csv", "NODE,MW\n" + "x,1\n" * (10 if i else 20_000))
    df = read_price_archives(spark, str(tmp_path))
    assert df.count() == 20_110
    from gridledger.sources.prices import PriceArchiveReader
    reader = PriceArchiveReader({"path": str(tmp_path), "split": "20000"})
    parts = [[p[0].rsplit("/", 1)[1] for p in part.value] for part in reader.partitions()]
    assert parts[0] == ["0.zip"] and sorted(n for p in parts for n in p) == sorted(f"{i}.zip" for i in range(12)) and len(parts) == 2


def test_small_members_read_as_rows_equal_the_arrow_reader(tmp_path, monkeypatch):
    import random

    from gridledger.sources import prices

    def records(path, small):
        monkeypatch.setattr(prices, "SMALL", small)
        with open(path, "rb") as stream:
            return [r for b in prices._batched(prices.archive_batches(stream, "p", path.stat().st_size)) for r in b.to_pylist()]

    def first(path):
        with open(path, "rb") as stream:
            return next(prices.archive_batches(stream, "p", path.stat().st_size))

    rng = random.Random(5)
    cells = ["a", " ", "", "\u00a0x ", '"q,""r"""', '"two\nlines"', '"two\r\nlines"', "caf\u00e9", "1.5", 'in"side']
    for number in range(60):
        lines = [",".join(rng.choices(cells, k=rng.choice([5, 5, 5, 3, 7]))) for _ in range(rng.randint(0, 8))]
        text = rng.choice(["", "\n"]) + rng.choice(["\n", "\r\n"]).join(["node,NODE,MW, opr dt,other", *lines, ""])
        path = tmp_path / f"{number}.zip"
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("a.csv", text.encode(rng.choice(["utf-8", "utf-8-sig", "windows-1252"])))
        arrow, small = records(path, 0), records(path, 1 << 16)
        assert small == sorted(arrow, key=lambda r: r["row_no"])
        assert isinstance(first(path), list) or not lines  # no Arrow reader for a small member


def test_the_driver_holds_no_name_of_an_archive(spark, tmp_path, monkeypatch):
    """Tasks list folders within folders; what the driver hands to the reading tasks does not grow with the files."""
    from gridledger.sources import landed

    for n in range(300):
        folder = tmp_path / "deep" / f"{n % 3}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"archive{n}.zip").write_bytes(b"" if n % 2 else b"no archive" * 9)
    (tmp_path / "none").mkdir()
    (tmp_path / "deep" / "_archive.zip").write_bytes(b"")
    (tmp_path / "deep" / "gone").symlink_to("nowhere")
    monkeypatch.setattr(landed, "LISTED", 40, raising=False)  # so that several tasks deal the files
    df = read_price_archives(spark, f"file://{tmp_path}")
    handed = [bytes(spark._jvm.org.apache.spark.util.Utils.serialize(p)) for p in df._jdf.queryExecution().toRdd().partitions()]
    assert not any(b"archive" in p for p in handed) and len(handed) == 8
    assert sorted((r.path, r.reject_reason) for r in df.collect()) == sorted(
        (f"file://{tmp_path}/deep/{n % 3}/archive{n}.zip", "empty_response" if n % 2 else "bad_zip") for n in range(300))
    assert read_price_archives(spark, str(tmp_path / "none")).count() == 0
    assert read_price_archives(spark, str(tmp_path / "deep" / "0" / "archive0.zip")).count() == 1


def test_folders_of_any_store_are_listed_alike(tmp_path, monkeypatch):
    import pyarrow.fs as pafs

    from gridledger.sources import landed

    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, body in (("x.zip", b"123"), (".y", b""), ("_z", b""), ("b/in.zip", b"")):
        (tmp_path / "a" / name).write_bytes(body)
    want = [("a/b", None), ("a/x.zip", 3)]
    assert sorted(landed.entries(f"{tmp_path}/a")) == [(f"{tmp_path}/{p}", n) for p, n in want]
    store = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    monkeypatch.setattr(landed, "file_system", lambda path: (store, path.removeprefix("mem://"), "mem://"))
    assert sorted(landed.entries("mem://a")) == [(f"mem://{p}", n) for p, n in want]


def test_landed_files_are_spread_over_folders(spark, tmp_path):
    from gridledger.sources import landed

    files = spark.range(2_000).selectExpr("concat('c', id, '.zip') path", "cast('' as binary) content")
    landed.land_files(files, str(tmp_path / "in"))
    landed.land_files(files, str(tmp_path / "in"))  # again: the same files
    held = [len(list(d.iterdir())) for d in (tmp_path / "in").iterdir()]
    assert sum(held) == 2_000 and len(held) == landed.SPREAD and max(held) < 100
    assert landed.listed_files(spark, str(tmp_path / "in"))[1] == 2_000
