"""Price windows, selection, coverage and summaries on ``events`` and ``orders``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.text import is_lmp_component, norm_text
from gridledger.functions.times import (
    day_end_utc, day_start_utc, expected_intervals, market_date_form, market_date_status,
    resolve_market_date)
from gridledger.operators.joins import join_price_window
from gridledger.operators.labels import resolve_hub, resolve_price_market
from gridledger.operators.prices import (
    PriceDays, coverage_status, display_hub, price_answer_text, price_day_summary, reject_files,
    select_lmp_rows, summarize_days, summarize_prices, with_window)
from gridledger.operators.ranking import flag_duplicates
from gridledger.operators.records import observed_text, price_records
from gridledger.plans.prices import answer_prices, resolve_price_questions
from gridledger.queries.base import (
    AS_OF, ORACLES, nth, register, spread_table, sql_list, sql_nth, sql_rows, table, utc_text)
from gridledger.session import shared_folder
from gridledger.sources.prices import normalize_price_rows, typed_price_rows

HUB_NAMES = tuple(h[0] for h in fv.HUBS)
COMPONENTS = ("LMP", "LMP_PRC", "MCC", "X_LMP", "MCC_LMP")
ZONE_SQL = "(({0}) AT TIME ZONE 'UTC') AT TIME ZONE 'America/Los_Angeles'"
TO_UTC_SQL = "(({0}) AT TIME ZONE 'America/Los_Angeles') AT TIME ZONE 'UTC'"


def local_sql(c: str) -> str:
    return ZONE_SQL.format(c)


def to_utc_sql(c: str) -> str:
    return TO_UTC_SQL.format(c)


# ---- hourly price rows derived from events ------------------------------------
def hourly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean event value (whole cents) per hub and hour, as raw text rows under one header variant."""
    ev = table(spark, sf_dir, "events")
    hourly = ev.groupBy(F.date_trunc("hour", "ts").alias("h"),
                        nth(HUB_NAMES, F.col("user_id")).alias("node")).agg(
        F.expr("sum(cast(round(value * 100) as bigint)) div count(*)").alias("cents"))
    stamp = "yyyy-MM-dd'T'HH:mm:ss"
    return hourly.select(
        F.concat(F.date_format("h", stamp), F.lit("-00:00")).alias("IntervalStartTime GMT"),
        F.concat(F.date_format(F.col("h") + F.expr("interval 1 hour"), stamp),
                 F.lit("-00:00")).alias("INTERVAL_END_GMT"),
        F.lit("").alias("MARKET_RUN_ID"), F.lit(" dam ").alias("market"),
        F.lower("node").alias("node id"), F.lit("LMP").alias("lmp-type"),
        (F.col("cents") / 100).cast("string").alias("MW"))


HOURLY_SQL = f"""hourly AS (
  SELECT date_trunc('hour', ts) AS h, {sql_nth(HUB_NAMES, 'user_id')} AS location, 'DAM' AS market,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) // count(*) / 100.0 AS price, false AS refused
  FROM events GROUP BY ALL)"""
# One file per hub and UTC day; every seventh day's file has a row of another component without its location.
FILED_SQL = HOURLY_SQL.replace("false AS refused", "extract(day FROM date_trunc('hour', ts)) % 7 = 3 AS refused")

DAYS_SQL = f"""days AS (
  SELECT location, market, CAST({local_sql('h')} AS DATE) AS market_date, count(*) AS actual_count,
         count(*) AS row_count, bool_or(refused) AS refused, avg(price) AS average_price, min(price) AS minimum_price,
         max(price) AS maximum_price, arg_min(h, (price, h)) AS minimum_start,
         arg_max(h, (price, -epoch(h))) AS maximum_start
  FROM hourly GROUP BY ALL),
summary AS (
  SELECT *, CAST(date_diff('minute', {to_utc_sql('CAST(market_date AS TIMESTAMP)')},
                 {to_utc_sql('CAST(market_date + 1 AS TIMESTAMP)')}) // 60 AS INTEGER) AS expected_count
  FROM days)"""

SUMMARY_COLUMNS_SQL = """location, market, CAST(market_date AS VARCHAR) AS market_date, row_count, actual_count,
  expected_count, CASE WHEN refused THEN 'missing_location' WHEN actual_count = expected_count THEN 'complete' ELSE 'incomplete' END AS coverage,
  round(average_price, 6) AS average_price, minimum_price, maximum_price,
  strftime(minimum_start, '%Y-%m-%d %H:%M:%S') AS minimum_start,
  strftime(maximum_start, '%Y-%m-%d %H:%M:%S') AS maximum_start"""


def typed_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_price_rows(normalize_price_rows(hourly_rows(spark, sf_dir)))


def filed_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly rows in files; some files have a row of another component without its location."""
    rows = hourly_rows(spark, sf_dir)
    stamp = F.col("`IntervalStartTime GMT`")
    rows = rows.withColumn("file", F.concat_ws("/", "node id", F.substring(stamp, 1, 10)))
    faulty = rows.where(F.substring(stamp, 9, 2).cast("int") % 7 == 3).withColumns(
        {"node id": F.lit(" "), "lmp-type": F.lit("MCC")})
    return typed_price_rows(normalize_price_rows(rows.unionByName(faulty), keep=("file",)))


def summary_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "location", "market", F.col("market_date").cast("string").alias("market_date"), "row_count",
        "actual_count", "expected_count", "coverage", F.round("average_price", 6).alias("average_price"),
        "minimum_price", "maximum_price", utc_text(F.col("minimum_start")).alias("minimum_start"),
        utc_text(F.col("maximum_start")).alias("maximum_start"))


@register("price_day_summary", f"WITH {FILED_SQL}, {DAYS_SQL} SELECT {SUMMARY_COLUMNS_SQL} FROM summary")
def _price_day_summary(spark, sf_dir):
    return summary_columns(price_day_summary(filed_hourly(spark, sf_dir), file="file"))


@register("normalize_price_rows", f"""WITH {HOURLY_SQL} SELECT lower(location) AS location, 'dam' AS market, 'LMP' AS component,
  strftime(h, '%Y-%m-%d %H:%M:%S') AS start_text, strftime(h + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS end_text,
  price FROM hourly""")
def _normalize_price_rows(spark, sf_dir):
    rows = typed_hourly(spark, sf_dir)
    return rows.select("location", "market", "component", utc_text(F.col("start_ts")).alias("start_text"),
                       utc_text(F.col("end_ts")).alias("end_text"), F.col("price_value").alias("price"))


# ---- one price row per event: faults, duplicates, several components -----------
def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    start = F.date_trunc("hour", "ts")
    broken = F.pmod(F.col("event_id"), F.lit(997)) == 3
    return ev.select(
        "event_id", F.concat(F.lit("file-"), F.pmod("event_id", F.lit(211))).alias("file"),
        F.when(F.pmod("event_id", F.lit(2111)) == 5, "").otherwise(
            nth(HUB_NAMES, F.col("user_id"))).alias("NODE"),
        F.lit("DAM").alias("MARKET"), nth(COMPONENTS, F.col("event_id")).alias("COMPONENT"),
        F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("STARTTIME_GMT"),
        F.when(F.pmod("event_id", F.lit(499)) == 7, F.date_format(start, "yyyy-MM-dd HH:mm:ss")).otherwise(
            F.date_format(start + F.expr("interval 1 hour"), "yyyy-MM-dd HH:mm:ss")).alias("ENDTIME_GMT"),
        F.when(broken, "n/a").otherwise(F.format_string("%.2f", "value")).alias("PRICE"))


EVENT_ROWS_SQL = f"""rows AS (
  SELECT event_id, 'file-' || (event_id % 211) AS file,
    CASE WHEN event_id % 2111 = 5 THEN NULL ELSE {sql_nth(HUB_NAMES, 'user_id')} END AS location,
    'DAM' AS market, {sql_nth(COMPONENTS, 'event_id')} AS component, date_trunc('hour', ts) AS start_ts,
    CASE WHEN event_id % 499 = 7 THEN date_trunc('hour', ts)
         ELSE date_trunc('hour', ts) + INTERVAL 1 HOUR END AS end_ts,
    CASE WHEN event_id % 997 = 3 THEN NULL ELSE round(value, 2) END AS price
  FROM events)"""
LMP_SQL = """lmp AS (SELECT *, CAST({local} AS DATE) AS market_date,
    CASE WHEN file IN (SELECT file FROM rows WHERE location IS NULL) THEN 'missing_location'
         WHEN end_ts <= start_ts THEN 'invalid_interval' WHEN price IS NULL THEN 'invalid_price' END AS bad_row
  FROM rows WHERE component IN ('LMP', 'LMP_PRC', 'X_LMP'))""".format(local=local_sql("start_ts"))


def typed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed_price_rows(normalize_price_rows(event_rows(spark, sf_dir), keep=("event_id", "file")))


@register("select_lmp_rows", f"""WITH {EVENT_ROWS_SQL}, {LMP_SQL}
SELECT event_id, location, component, CAST(market_date AS VARCHAR) AS market_date,
       coalesce(bad_row, 'ok') AS row_state FROM lmp""")
def _select_lmp_rows(spark, sf_dir):
    rows = select_lmp_rows(typed_events(spark, sf_dir), file="file")
    return rows.select("event_id", "location", "component",
                       F.col("market_date").cast("string").alias("market_date"),
                       F.coalesce("bad_row", F.lit("ok")).alias("row_state"))


@register("reject_price_files", f"""WITH {EVENT_ROWS_SQL}
SELECT file, 'missing_location' AS reject_reason FROM rows WHERE location IS NULL GROUP BY file""")
def _reject_price_files(spark, sf_dir):
    return reject_files(typed_events(spark, sf_dir), "file")


@register("coverage_status", f"""WITH {EVENT_ROWS_SQL}, {LMP_SQL},
g AS (SELECT location, market, market_date, count(*) AS row_count, count(DISTINCT start_ts) AS actual_count,
             min(bad_row) AS bad FROM lmp GROUP BY ALL)
SELECT location, market, CAST(market_date AS VARCHAR) AS market_date, row_count, actual_count,
  CASE WHEN bad IS NOT NULL THEN bad WHEN row_count > actual_count THEN 'duplicate'
       WHEN actual_count = date_diff('hour', {to_utc_sql('CAST(market_date AS TIMESTAMP)')},
            {to_utc_sql('CAST(market_date + 1 AS TIMESTAMP)')}) THEN 'complete' ELSE 'incomplete' END AS coverage
FROM g""")
def _coverage_status(spark, sf_dir):
    rows = select_lmp_rows(typed_events(spark, sf_dir), file="file")
    out = coverage_status(with_window(summarize_days(rows)))
    return out.select("location", "market", F.col("market_date").cast("string").alias("market_date"),
                      "row_count", "actual_count", "coverage")


@register("flag_duplicate_intervals", f"""WITH {EVENT_ROWS_SQL}, {LMP_SQL}
SELECT location, CAST(market_date AS VARCHAR) AS market_date, count(*) AS row_count,
       count(DISTINCT start_ts) AS distinct_starts, count(*) > count(DISTINCT start_ts) AS has_duplicates
FROM lmp GROUP BY location, lmp.market_date""")
def _flag_duplicates(spark, sf_dir):
    rows = select_lmp_rows(typed_events(spark, sf_dir), file="file")
    return flag_duplicates(rows, ["location", "market_date"]).withColumn(
        "market_date", F.col("market_date").cast("string"))


# ---- calendar expressions on orders ---------------------------------------------
ORDER_DAYS_SQL = "d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)"


@register("market_day_window", f"""WITH {ORDER_DAYS_SQL}
SELECT CAST(day AS VARCHAR) AS market_date,
  strftime({to_utc_sql('CAST(day AS TIMESTAMP)')}, '%Y-%m-%d %H:%M:%S') AS utc_start,
  strftime({to_utc_sql('CAST(day + 1 AS TIMESTAMP)')}, '%Y-%m-%d %H:%M:%S') AS utc_end,
  CAST(date_diff('hour', {to_utc_sql('CAST(day AS TIMESTAMP)')}, {to_utc_sql('CAST(day + 1 AS TIMESTAMP)')}) AS BIGINT) AS local_hours
FROM d""")
def _market_day_window(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    start, end = day_start_utc(F.col("day")), day_end_utc(F.col("day"))
    return days.select(F.col("day").cast("string").alias("market_date"), utc_text(start).alias("utc_start"),
                       utc_text(end).alias("utc_end"),
                       ((F.unix_timestamp(end) - F.unix_timestamp(start)) / 3600).cast("bigint").alias("local_hours"))


@register("expected_intervals", f"""WITH {ORDER_DAYS_SQL}, m(market, minutes) AS (VALUES ('DAM', 60), ('FMM', 15), ('RTM', 5))
SELECT CAST(day AS VARCHAR) AS market_date, market,
  CAST(date_diff('minute', {to_utc_sql('CAST(day AS TIMESTAMP)')}, {to_utc_sql('CAST(day + 1 AS TIMESTAMP)')}) // minutes AS INTEGER) AS expected_count
FROM d CROSS JOIN m""")
def _expected_intervals(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    days = days.withColumn("market", F.explode(F.array(F.lit("DAM"), F.lit("FMM"), F.lit("RTM"))))
    count = expected_intervals(day_start_utc(F.col("day")), day_end_utc(F.col("day")), F.col("market"))
    return days.select(F.col("day").cast("string").alias("market_date"), "market",
                       count.alias("expected_count"))


@register("is_lmp_component", f"""SELECT event_id, {sql_nth(COMPONENTS + ('lmp price', ' Lmp_Cong_Ene_Loss ', 'LMP-MCE', 'DA_LMP', 'MCL_LMP'), 'event_id')} AS component,
  {sql_nth(('T', 'T', 'F', 'T', 'F', 'T', 'T', 'F', 'T', 'F'), 'event_id')} = 'T' AS accepted FROM events""")
def _is_lmp_component(spark, sf_dir):
    names = COMPONENTS + ("lmp price", " Lmp_Cong_Ene_Loss ", "LMP-MCE", "DA_LMP", "MCL_LMP")
    ev = table(spark, sf_dir, "events").select("event_id", nth(names, F.col("event_id")).alias("component"))
    return ev.withColumn("accepted", is_lmp_component(F.col("component")))


# ---- price questions derived from orders ------------------------------------------
ASKS = (
    "What was the NP-15 {m} on {d}?", "average sp15 {m} for {d}", "zone path 26 {m} {d}",
    "northern california trading hub {m} {d}", "NP15 and SP15 {m} {d}", "Houston hub {m} {d}",
    "north path 15 {m} on {d} please",
)
MARKET_WORDS = ("day-ahead price", "DAM LMP", "da prices", "fifteen minute price", "15 minute price",
                "real-time price", "price", "dayahead settlement", "day ahead LMP", "rt15 price")
MONTHS = ("January", "Jan", "january")


def _date_text(day, pick):
    d = lambda p: F.date_format(day, p)
    return (
        F.when(pick == 0, d("yyyy-MM-dd")).when(pick == 1, F.concat(F.lit("January "), d("d"), F.lit(", "), d("yyyy")))
        .when(pick == 2, F.concat(d("d"), F.lit("th Jan "), d("yyyy")))
        .when(pick == 3, d("M/d/yyyy")).when(pick == 4, "yesterday").when(pick == 5, "the day before yesterday")
        .when(pick == 6, "today").when(pick == 7, "2024-02-31").when(pick == 8, "some day")
        .when(pick == 9, "February 30, 2024").when(pick == 10, F.concat(F.lit("jan "), d("d"), F.lit("st "), d("yyyy")))
        .otherwise(d("M/d/yyyy")))


DATE_TEXT_SQL = """CASE o_custkey % 12 WHEN 0 THEN strftime(day, '%Y-%m-%d')
  WHEN 1 THEN 'January ' || extract(day FROM day) || ', ' || extract(year FROM day)
  WHEN 2 THEN extract(day FROM day) || 'th Jan ' || extract(year FROM day)
  WHEN 4 THEN 'yesterday' WHEN 5 THEN 'the day before yesterday' WHEN 6 THEN 'today'
  WHEN 7 THEN '2024-02-31' WHEN 8 THEN 'some day' WHEN 9 THEN 'February 30, 2024'
  WHEN 10 THEN 'jan ' || extract(day FROM day) || 'st ' || extract(year FROM day)
  ELSE extract(month FROM day) || '/' || extract(day FROM day) || '/' || extract(year FROM day) END"""


def price_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spread_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", rows=100_000)
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("o_orderkey", F.lit(31)).cast("int"))
    text = _date_text(day, F.pmod("o_custkey", F.lit(12)))
    ask = nth(ASKS, F.col("o_orderkey"))
    question = F.replace(F.replace(ask, F.lit("{m}"), nth(MARKET_WORDS, F.expr("o_orderkey div 7"))),
                         F.lit("{d}"), text)
    return orders.select(F.col("o_orderkey").alias("question_id"), question.alias("question"),
                         F.lit(AS_OF).cast("timestamp").alias("as_of"), day.alias("day"))


PRICE_QUESTIONS_SQL = f"""q0 AS (SELECT *, CAST(DATE '2024-01-01' + CAST(o_orderkey % 31 AS INTEGER) AS DATE) AS day FROM orders),
q AS (SELECT o_orderkey AS question_id, o_orderkey % 7 AS ask, (o_orderkey // 7) % 10 AS mw, o_custkey % 12 AS form, day,
   replace(replace({sql_nth(ASKS, 'o_orderkey')}, '{{m}}', {sql_nth(MARKET_WORDS, 'o_orderkey // 7')}), '{{d}}', {DATE_TEXT_SQL}) AS question FROM q0),
r AS (SELECT *, CASE ask WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 0 WHEN 6 THEN 0 END AS hub,
   CASE WHEN mw IN (0, 1, 2, 7, 8) THEN 'DAM' WHEN mw IN (3, 9) THEN 'FMM' WHEN mw = 4 THEN 'AMBIGUOUS'
        WHEN mw = 5 THEN 'RTM' ELSE 'UNSPECIFIED' END AS market,
   CASE form WHEN 4 THEN DATE '2024-01-02' WHEN 5 THEN DATE '2024-01-01' WHEN 6 THEN DATE '2024-01-03'
        WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 9 THEN NULL ELSE day END AS market_date FROM q),
resolved AS (SELECT *, {sql_list(HUB_NAMES)}[hub + 1] AS location, ['NP-15', 'SP-15', 'ZP-26'][hub + 1] AS display_name,
   CASE WHEN hub IS NULL THEN 'unsupported_location' WHEN market = 'UNSPECIFIED' THEN 'needs_clarification'
        WHEN market = 'AMBIGUOUS' THEN 'ambiguous_market' WHEN market_date IS NOT NULL THEN 'resolved'
        WHEN form = 8 THEN 'missing_date' ELSE 'invalid_date' END AS status FROM r)"""


@register("resolve_market_date", f"""WITH {PRICE_QUESTIONS_SQL}
SELECT question_id, CAST(market_date AS VARCHAR) AS market_date,
  CASE WHEN market_date IS NOT NULL THEN 'resolved' WHEN form = 8 THEN 'missing_date' ELSE 'invalid_date' END AS date_status
FROM resolved""")
def _resolve_market_date(spark, sf_dir):
    q = price_questions(spark, sf_dir)
    day = resolve_market_date(F.col("question"), F.col("as_of"))
    return q.withColumn("d", day).select(
        "question_id", F.col("d").cast("string").alias("market_date"),
        market_date_status(F.col("question"), F.col("d")).alias("date_status"))


@register("resolve_price_questions", f"""WITH {PRICE_QUESTIONS_SQL}
SELECT question_id, question, location, market, CAST(market_date AS VARCHAR) AS market_date, status,
  strftime({to_utc_sql('CAST(market_date AS TIMESTAMP)')}, '%Y-%m-%d %H:%M:%S') AS utc_start,
  strftime({to_utc_sql('CAST(market_date + 1 AS TIMESTAMP)')}, '%Y-%m-%d %H:%M:%S') AS utc_end FROM resolved""")
def _resolve_price_questions(spark, sf_dir):
    q = resolve_price_questions(price_questions(spark, sf_dir))
    return q.select("question_id", "question", "location", "market",
                    F.col("market_date").cast("string").alias("market_date"), "status",
                    utc_text(F.col("utc_start")).alias("utc_start"), utc_text(F.col("utc_end")).alias("utc_end"))


WANTED_SQL = """asked AS (SELECT DISTINCT location, market, market_date FROM resolved WHERE status = 'resolved')"""


def _asked(spark, sf_dir):
    q = resolve_price_questions(price_questions(spark, sf_dir)).where("status = 'resolved'")
    return q.select("location", "market", "market_date").distinct()


@register("summarize_prices", f"""WITH {PRICE_QUESTIONS_SQL}, {WANTED_SQL}, {FILED_SQL}, {DAYS_SQL}
SELECT a.location, a.market, CAST(a.market_date AS VARCHAR) AS market_date,
  CASE WHEN s.row_count IS NULL THEN 'empty' WHEN s.refused THEN 'missing_location' WHEN s.actual_count = s.expected_count THEN 'complete' ELSE 'incomplete' END AS coverage,
  coalesce(s.actual_count, 0) AS actual_count, coalesce(round(s.average_price, 6), -1) AS average_price,
  coalesce(s.minimum_price, -1) AS minimum_price, coalesce(s.maximum_price, -1) AS maximum_price
FROM asked a LEFT JOIN summary s USING (location, market, market_date)""")
def _summarize_prices(spark, sf_dir):
    out = summarize_prices(filed_hourly(spark, sf_dir), _asked(spark, sf_dir), file="file")
    return out.select(
        "location", "market", F.col("market_date").cast("string").alias("market_date"), "coverage",
        F.coalesce("actual_count", F.lit(0)).alias("actual_count"),
        F.coalesce(F.round("average_price", 6), F.lit(-1.0)).alias("average_price"),
        F.coalesce("minimum_price", F.lit(-1.0)).alias("minimum_price"),
        F.coalesce("maximum_price", F.lit(-1.0)).alias("maximum_price"))


@register("join_price_window", f"""WITH {PRICE_QUESTIONS_SQL}, {WANTED_SQL}, {HOURLY_SQL}
SELECT a.location, CAST(a.market_date AS VARCHAR) AS market_date, strftime(h, '%Y-%m-%d %H:%M:%S') AS start_text, price
FROM asked a JOIN hourly r ON a.location = r.location AND a.market = r.market
  AND h >= {to_utc_sql('CAST(a.market_date AS TIMESTAMP)')} AND h < {to_utc_sql('CAST(a.market_date + 1 AS TIMESTAMP)')}""")
def _join_price_window(spark, sf_dir):
    rows = select_lmp_rows(typed_hourly(spark, sf_dir))
    out = join_price_window(rows, _asked(spark, sf_dir))
    return out.select("location", F.col("market_date").cast("string").alias("market_date"),
                      utc_text(F.col("start_ts")).alias("start_text"), F.col("price_value").alias("price"))


@register("answer_prices", f"""WITH {PRICE_QUESTIONS_SQL}, {FILED_SQL}, {DAYS_SQL},
j AS (SELECT r.question_id, r.status AS s0, r.display_name, r.market, r.market_date, s.actual_count, s.average_price,
        s.minimum_price, s.maximum_price, coalesce(s.actual_count = s.expected_count AND NOT s.refused, false) AS complete
      FROM resolved r LEFT JOIN summary s ON r.status = 'resolved' AND r.location = s.location
        AND r.market = s.market AND r.market_date = s.market_date)
SELECT question_id, CASE WHEN s0 <> 'resolved' THEN s0 WHEN complete THEN 'answered' ELSE 'held' END AS status,
  CASE WHEN complete THEN 'high' ELSE 'insufficient' END AS confidence,
  CASE WHEN s0 = 'needs_clarification' THEN 'Please specify which CAISO market price you want.'
       WHEN complete THEN printf('%s %s LMP averaged $%s/MWh on %s.', display_name, market, CAST(round(CAST(average_price AS DECIMAL(18,6)), 2) AS VARCHAR),
                                 strftime(market_date, '%Y-%m-%d'))
       ELSE 'The CAISO price answer was held.' END AS direct_answer,
  CASE WHEN complete THEN printf('The official CAISO result contained %d validated intervals. The minimum was $%s/MWh and the maximum was $%s/MWh.',
       actual_count, CAST(CAST(minimum_price AS DECIMAL(18,2)) AS VARCHAR), CAST(CAST(maximum_price AS DECIMAL(18,2)) AS VARCHAR)) END AS simple_explanation FROM j""")
def _answer_prices(spark, sf_dir):
    out = answer_prices(price_questions(spark, sf_dir), filed_hourly(spark, sf_dir), file="file")
    return out.select("question_id", "status", "confidence", "direct_answer", "simple_explanation")


# ---- the same questions of prices landed by market date -----------------------------------
def landed_prices(spark: SparkSession, sf_dir: str) -> PriceDays:
    return PriceDays.land(filed_hourly(spark, sf_dir), shared_folder(spark), "file")


@register("landed_day_summary", ORACLES["price_day_summary"])
def _landed_day_summary(spark, sf_dir):
    return summary_columns(landed_prices(spark, sf_dir).summary())


@register("refused_landed_files", f"""WITH {EVENT_ROWS_SQL}, {PRICE_QUESTIONS_SQL}, {WANTED_SQL},
touched AS (SELECT DISTINCT file FROM rows WHERE CAST({local_sql('start_ts')} AS DATE) IN (SELECT market_date FROM asked))
SELECT file, 'missing_location' AS reject_reason FROM rows JOIN touched USING (file) WHERE location IS NULL GROUP BY file""")
def _refused_landed_files(spark, sf_dir):
    days = PriceDays.land(typed_events(spark, sf_dir), shared_folder(spark), "file")
    found = days.refused(_asked(spark, sf_dir))
    return found.select(F.col("_file").alias("file"), F.col("_refused").alias("reject_reason"))


@register("answer_landed_prices", ORACLES["answer_prices"])
def _answer_landed_prices(spark, sf_dir):
    out = answer_prices(price_questions(spark, sf_dir), landed_prices(spark, sf_dir))
    return out.select("question_id", "status", "confidence", "direct_answer", "simple_explanation")


@register("price_answer_text", f"""WITH {HOURLY_SQL}, {DAYS_SQL}
SELECT location, CAST(market_date AS VARCHAR) AS market_date,
  printf('%s %s LMP averaged $%s/MWh on %s.', CASE location WHEN 'TH_NP15_GEN-APND' THEN 'NP-15' WHEN 'TH_SP15_GEN-APND' THEN 'SP-15' ELSE 'ZP-26' END,
         market, CAST(round(CAST(average_price AS DECIMAL(18,6)), 2) AS VARCHAR), strftime(market_date, '%Y-%m-%d')) AS direct_answer FROM summary""")
def _price_answer_text(spark, sf_dir):
    days = price_day_summary(typed_hourly(spark, sf_dir))
    direct, _ = price_answer_text(display_hub(F.col("location")))
    return days.select("location", F.col("market_date").cast("string").alias("market_date"),
                       direct.alias("direct_answer"))


@register("price_records", f"""WITH {FILED_SQL}, {DAYS_SQL}
SELECT location, CAST(market_date AS VARCHAR) AS market_date, 'caiso_oasis' AS provider_id, 'structured_api' AS method,
  strftime({to_utc_sql('CAST(market_date + 1 AS TIMESTAMP)')}, '%Y-%m-%dT%H:%M:%S+00:00') AS observed_text,
  'USD/MWh' AS unit, 'CAISO DAM ' || CASE location WHEN 'TH_NP15_GEN-APND' THEN 'NP-15' WHEN 'TH_SP15_GEN-APND' THEN 'SP-15' ELSE 'ZP-26' END AS market,
  'America/Los_Angeles' AS timezone, 'hourly' AS interval_name, actual_count = expected_count AND NOT refused AS complete_coverage, true AS is_primary
FROM summary""")
def _price_records(spark, sf_dir):
    days = price_day_summary(filed_hourly(spark, sf_dir), file="file").withColumn("display_name", display_hub(F.col("location")))
    direct, explain = price_answer_text(F.col("display_name"))
    days = days.withColumns({"direct_answer": direct, "simple_explanation": explain})
    recs = observed_text(price_records(days, ("location", "market_date")))
    return recs.select("location", F.col("market_date").cast("string").alias("market_date"), "provider_id",
                       "method", "observed_text", "payload.unit", "payload.market", "payload.timezone",
                       F.col("payload.interval").alias("interval_name"), "flags.complete_coverage", "is_primary")


@register("resolve_hub", f"""WITH {PRICE_QUESTIONS_SQL} SELECT question_id, location, display_name, market FROM resolved""")
def _resolve_hub(spark, sf_dir):
    q = price_questions(spark, sf_dir).withColumn("n", norm_text(F.col("question")))
    return q.withColumn("h", resolve_hub("n")).select(
        "question_id", "h.location", "h.display_name", resolve_price_market("n").alias("market"))


_FORMS = ("iso", "month_first", "day_first", "slash", "yesterday", "two_days_back", "today", "iso",
          "none", "month_first", "month_first", "slash")


@register("market_date_form", f"""WITH {PRICE_QUESTIONS_SQL} SELECT question_id, {sql_list(_FORMS)}[form + 1] AS date_form FROM q""")
def _market_date_form(spark, sf_dir):
    q = price_questions(spark, sf_dir)
    return q.select("question_id", market_date_form(F.col("question")).alias("date_form"))


# ---- alias look-up -------------------------------------------------------------------
SPELLINGS = ("caiso", "California  ISO", "ercot", "PJM", "iso_ne", "ISO-NE", "nyis", "SWPP", "unknown grid", "miso")


@register("join_alias", f"""WITH dim(spelling, code) AS (VALUES {sql_rows(fv.AUTHORITY_SPELLINGS)}),
q AS (SELECT event_id, {sql_nth(SPELLINGS, 'event_id')} AS spelled FROM events)
SELECT event_id, spelled, code, CASE WHEN code IS NULL THEN 'unknown_alias' ELSE 'ok' END AS state
FROM q LEFT JOIN dim ON dim.spelling = trim(regexp_replace(replace(upper(spelled), '_', ' '), '\\s+', ' ', 'g'))""")
def _join_alias(spark, sf_dir):
    from gridledger import dims
    from gridledger.operators.joins import authority_key, join_alias

    ev = table(spark, sf_dir, "events").select("event_id", nth(SPELLINGS, F.col("event_id")).alias("spelled"))
    out = join_alias(ev, dims.authority_spellings(spark), authority_key(F.col("spelled")), "spelling", "code")
    return out.select("event_id", "spelled", "code", F.coalesce("reject_reason", F.lit("ok")).alias("state"))
