"""Hourly series on JSON lines derived from ``events``, and operating-data questions."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.numbers import parse_numeric, parse_opt_int, parse_price
from gridledger.functions.text import equivalent_mw, is_hourly_energy_unit, series_id
from gridledger.functions.times import age_hours, is_stale, parse_period, parse_price_ts
from gridledger.operators.joins import join_latest_series
from gridledger.operators.labels import resolve_operating_questions
from gridledger.operators.ranking import keep_last, sort_series
from gridledger.operators.records import observed_text, operating_records
from gridledger.operators.series import latest_observations, series_stats
from gridledger.plans.series import answer_operating
from gridledger.queries.base import (
    AS_OF, QUESTIONS_SQL, joined, nth, questions, register, sql_list, sql_nth, table,
    utc_text)
from gridledger.sources.series import explode_observations, parse_series_lines, valid_series

CODES = ("CISO", "ERCO", "PJM", "MISO", "SWPP", "NYIS", "ISNE")
METRICS = ("D", "DF", "NG", "TI")
UNITS = ("megawatthours", "MWh", "megawatt-hours", "thousand cubic feet", "Mega Watt Hour")


def series_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON line per event: pairs, objects, null words, odd items and faults."""
    ev = table(spark, sf_dir, "events")
    h = F.date_trunc("hour", "ts")
    ident = F.concat(F.lit("EBA."), nth(CODES, F.col("event_id")), F.lit("-ALL."),
                     nth(METRICS, F.expr("event_id div 7")), F.lit(".H"))
    compact = F.date_format(h, "yyyyMMdd'T'HH'Z'")
    later = F.date_format(h + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    number = lambda c: c.cast("string")
    units = F.when(F.pmod("event_id", F.lit(109)) == 4, F.lit('"units": " "')).otherwise(
        F.concat(F.lit('"units": "'), nth(UNITS, F.col("event_id")), F.lit('"')))
    freq = F.when(F.pmod("event_id", F.lit(113)) == 5, "D").otherwise("H")
    data = F.concat(
        F.lit('[["'), compact, F.lit('", '), number(F.col("value")), F.lit('], ["'), compact,
        F.lit('", "null"], {"period": "'), later, F.lit('", "value": "'), number(F.col("value") + 1),
        F.lit('"}, 7, ["x"], {"value": 3}, ["'), compact, F.lit('", '), number(F.col("value") + 2),
        F.lit("]]"))
    listed = F.when(F.pmod("event_id", F.lit(127)) == 6, '"none"').otherwise(data)
    body = F.concat(F.lit('{"series_id": "'), ident, F.lit('", "name": "Series '),
                    F.col("event_id").cast("string"), F.lit('", '), units, F.lit(', "f": "'), freq,
                    F.lit('", "data": '), listed, F.lit("}"))
    line = (F.when(F.pmod("event_id", F.lit(101)) == 1, '{"series_id": "broken')
            .when(F.pmod("event_id", F.lit(103)) == 2, '{"category_id": 7, "name": "no series"}')
            .when(F.pmod("event_id", F.lit(107)) == 3, "   ").otherwise(body))
    return ev.select(F.lit("landed/series.txt").alias("file"), F.lit(0).cast("bigint").alias("block"),
                     F.col("event_id").alias("row"), line.alias("line"))


LINES_SQL = f"""lines AS (
  SELECT event_id, date_trunc('hour', ts) AS h, value,
    'EBA.' || {sql_nth(CODES, 'event_id')} || '-ALL.' || {sql_nth(METRICS, 'event_id // 7')} || '.H' AS series_id,
    CASE WHEN event_id % 109 = 4 THEN NULL ELSE {sql_nth(UNITS, 'event_id')} END AS unit,
    CASE WHEN event_id % 101 = 1 THEN 'malformed_json' WHEN event_id % 103 = 2 THEN 'no_series_id'
         WHEN event_id % 127 = 6 THEN 'no_data_array' END AS reject
  FROM events WHERE NOT (event_id % 107 = 3 AND event_id % 103 <> 2 AND event_id % 101 <> 1)),
checked AS (SELECT *, CASE WHEN reject IS NOT NULL THEN reject WHEN unit IS NULL THEN 'no_unit'
         WHEN event_id % 113 = 5 THEN 'not_hourly' END AS reason FROM lines),
obs AS (SELECT event_id, 0 AS pos, h AS ts, value FROM lines WHERE reject IS NULL
   UNION ALL SELECT event_id, 2, h + INTERVAL 2 HOUR, value + 1 FROM lines WHERE reject IS NULL
   UNION ALL SELECT event_id, 6, h, value + 2 FROM lines WHERE reject IS NULL)"""


def parsed(spark, sf_dir):
    return parse_series_lines(series_lines(spark, sf_dir))


@register("parse_series_lines", f"""WITH {LINES_SQL}
SELECT event_id, CASE WHEN reject IN ('malformed_json', 'no_series_id') THEN NULL ELSE series_id END AS series_id,
  coalesce(reject, 'ok') AS state FROM lines""")
def _parse_series_lines(spark, sf_dir):
    return parsed(spark, sf_dir).select(F.col("row").alias("event_id"), "series_id",
                                        F.coalesce("reject_reason", F.lit("ok")).alias("state"))


@register("valid_series", f"""WITH {LINES_SQL}
SELECT event_id, coalesce(reason, 'ok') AS state FROM checked""")
def _valid_series(spark, sf_dir):
    return valid_series(parsed(spark, sf_dir)).select(
        F.col("row").alias("event_id"), F.coalesce("reject_reason", F.lit("ok")).alias("state"))


@register("explode_observations", f"""WITH {LINES_SQL}
SELECT event_id, pos, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, value FROM obs""")
def _explode_observations(spark, sf_dir):
    rows = explode_observations(parsed(spark, sf_dir).where("reject_reason is null"), ("row",))
    return rows.select(F.col("row").alias("event_id"), "pos", utc_text(F.col("ts")).alias("ts_text"), "value")


def _daily(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select(F.concat_ws("-", "event_type", F.pmod("user_id", F.lit(40))).alias("series_id"),
                     F.date_trunc("day", "ts").alias("ts"), F.col("event_id").alias("pos"), "value")


DAILY_SQL = """daily AS (SELECT event_type || '-' || (user_id % 40) AS series_id, date_trunc('day', ts) AS ts,
   arg_max(value, event_id) AS value FROM events GROUP BY 1, 2)"""


@register("keep_last_observation", f"""WITH {DAILY_SQL}
SELECT series_id, strftime(ts, '%Y-%m-%d') AS day, value FROM daily""")
def _keep_last(spark, sf_dir):
    return keep_last(_daily(spark, sf_dir)).select(
        "series_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")


@register("series_stats", f"""WITH {DAILY_SQL}
SELECT series_id, count(*) AS observation_count, strftime(max(ts), '%Y-%m-%d') AS latest_day,
  arg_max(value, ts) AS latest_value FROM daily GROUP BY 1""")
def _series_stats(spark, sf_dir):
    return series_stats(keep_last(_daily(spark, sf_dir))).select(
        "series_id", "observation_count", F.date_format("latest_ts", "yyyy-MM-dd").alias("latest_day"),
        "latest_value")


@register("sort_series", f"""WITH {DAILY_SQL}
SELECT series_id, strftime(ts, '%Y-%m-%d') AS day, value FROM daily ORDER BY series_id, ts""")
def _sort_series(spark, sf_dir):
    return sort_series(keep_last(_daily(spark, sf_dir))).select(
        "series_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")


LATEST_SQL = f"""heads AS (SELECT * FROM checked WHERE coalesce(reject, 'no_data_array') = 'no_data_array'
   QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY event_id) = 1),
latest AS (SELECT series_id, unit, reason, CASE WHEN reason IS NULL THEN h + INTERVAL 2 HOUR END AS ts,
   CASE WHEN reason IS NULL THEN value + 1 END AS value, event_id FROM heads)"""


@register("latest_observations", f"""WITH {LINES_SQL}, {LATEST_SQL}
SELECT series_id, unit, coalesce(reason, 'ok') AS state, CASE WHEN reason IS NULL THEN 2 ELSE 0 END AS observation_count,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, coalesce(value, -1) AS value FROM latest""")
def _latest_observations(spark, sf_dir):
    out = latest_observations(parsed(spark, sf_dir))
    return out.select("series_id", "unit", F.coalesce("source_reject", F.lit("ok")).alias("state"),
                      F.coalesce("observation_count", F.lit(0)).alias("observation_count"),
                      utc_text(F.col("latest_ts")).alias("ts_text"),
                      F.coalesce("latest_value", F.lit(-1.0)).alias("value"))


# ---- operating-data questions --------------------------------------------------
def _first_match_sql(column: str, rules) -> str:
    whens = " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{label}'" for label, p in rules)
    return f"CASE {whens} END"


OPERATING_SQL = f"""{QUESTIONS_SQL},
op0 AS (SELECT *, {_first_match_sql('lower(question)', fv.AUTHORITY_PATTERNS)} AS authority,
   {_first_match_sql('lower(question)', [(m, p) for m, _, p in fv.METRIC_PATTERNS])} AS metric FROM questions),
op AS (SELECT *, 'EBA.' || {sql_list(CODES)}[list_position({sql_list([a for a, _ in fv.AUTHORITY_PATTERNS])}, authority)]
   || '-ALL.' || metric || '.H' AS series_id FROM op0)"""


@register("resolve_operating_questions", f"""WITH {OPERATING_SQL}
SELECT question_id, authority, metric, series_id,
  concat_ws('|', CASE WHEN authority IS NULL THEN 'balancing authority' END, CASE WHEN metric IS NULL THEN 'metric' END) AS missing,
  CASE WHEN series_id IS NULL THEN 'needs_clarification' ELSE 'resolved' END AS status FROM op""")
def _resolve_operating(spark, sf_dir):
    out = resolve_operating_questions(questions(spark, sf_dir))
    return out.select("question_id", "authority", "metric", "series_id",
                      joined(F.col("missing")).alias("missing"), "status")


@register("join_latest_series", f"""WITH {OPERATING_SQL}, {LINES_SQL}, {LATEST_SQL}
SELECT question_id, o.series_id, coalesce(l.value, -1) AS value,
  CASE WHEN l.series_id IS NULL THEN 'series_not_found' ELSE 'found' END AS state
FROM op o LEFT JOIN latest l USING (series_id)""")
def _join_latest_series(spark, sf_dir):
    asked = resolve_operating_questions(questions(spark, sf_dir))
    out = join_latest_series(asked, latest_observations(parsed(spark, sf_dir)))
    return out.select("question_id", "series_id", F.coalesce("latest_value", F.lit(-1.0)).alias("value"),
                      F.coalesce("reject_reason", F.lit("found")).alias("state"))


LABELS_SQL = " ".join(f"WHEN '{m}' THEN '{label}'" for m, label, _ in fv.METRIC_PATTERNS)
ANSWERED_SQL = f"""WITH {OPERATING_SQL}, {LINES_SQL}, {LATEST_SQL},
j AS (SELECT o.*, l.value, l.unit, l.ts, l.reason, date_diff('second', l.ts, TIMESTAMP '{AS_OF}') / 3600.0 AS age
      FROM op o LEFT JOIN latest l USING (series_id)),
k AS (SELECT *, age > 72 AS stale, value IS NOT NULL AND unit IS NOT NULL AND reason IS NULL AS usable FROM j)"""


@register("answer_operating", f"""{ANSWERED_SQL}
SELECT question_id,
  CASE WHEN series_id IS NULL THEN 'needs_clarification' WHEN NOT usable THEN 'held' WHEN stale THEN 'stale' ELSE 'answered' END AS status,
  CASE WHEN series_id IS NULL OR NOT usable THEN 'insufficient' WHEN stale THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN series_id IS NULL THEN 'Please specify the ' || concat_ws(' and ', CASE WHEN authority IS NULL THEN 'balancing authority' END,
         CASE WHEN metric IS NULL THEN 'metric' END) || '.'
       WHEN NOT usable THEN 'The operating-data answer was held.'
       ELSE 'EIA reported ' || authority || ' ' || CASE metric {LABELS_SQL} END || ' of ' || format('{{:,}}', CAST(round_even(value, 0) AS BIGINT)) || ' ' || unit
         || ' for the hourly interval ending ' || strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') || '.'
         || CASE WHEN stale THEN ' The observation is older than the configured freshness threshold.' ELSE '' END END AS direct_answer,
  CASE WHEN usable AND replace(replace(lower(unit), ' ', ''), '-', '') IN ('mwh', 'megawatthours', 'megawatthour') THEN CAST(value AS VARCHAR) END AS equivalent_mw
FROM k""")
def _answer_operating(spark, sf_dir):
    out = answer_operating(questions(spark, sf_dir), parsed(spark, sf_dir))
    return out.select("question_id", "status", "confidence", "direct_answer",
                      F.col("equivalent_mw").cast("string").alias("equivalent_mw"))


@register("operating_answer_age", f"""{ANSWERED_SQL}
SELECT question_id, coalesce(round(age, 4), -1) AS age_hours, coalesce(stale, false) AS stale FROM k""")
def _operating_age(spark, sf_dir):
    out = answer_operating(questions(spark, sf_dir), parsed(spark, sf_dir))
    return out.select("question_id", F.coalesce(F.round("age_hours", 4), F.lit(-1.0)).alias("age_hours"), "stale")


@register("operating_records", f"""{ANSWERED_SQL}
SELECT question_id, 'eia_bulk_eba' AS provider_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS observed_text,
  unit, authority AS market, true AS complete_coverage FROM k WHERE usable""")
def _operating_records(spark, sf_dir):
    out = answer_operating(questions(spark, sf_dir), parsed(spark, sf_dir))
    recs = observed_text(operating_records(out.where("status in ('answered', 'stale')")))
    return recs.select("question_id", "provider_id", "observed_text", "payload.unit", "payload.market",
                       "flags.complete_coverage")


# ---- scalar expressions on events -------------------------------------------------
_PERIODS = ("yyyyMMdd'T'HH'Z'", "yyyyMMdd'T'HH", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'-0800'",
            "yyyy-MM-dd'T'HH'+0530'", "yyyy-MM-dd'T'HH", "yyyy-MM-dd", "'not a period'")
_SHIFT = (0, 0, 0, 8 * 60, -330, 0, 0, 0)


def _period_text(ts):
    out = F.lit(None).cast("string")
    for i, pattern in enumerate(_PERIODS):
        out = F.when(F.pmod("event_id", F.lit(8)) == i, F.date_format(ts, pattern)).otherwise(out)
    return out


@register("parse_period", f"""SELECT event_id, CASE event_id % 8 WHEN 7 THEN NULL
  WHEN 6 THEN strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')
  ELSE strftime(CASE WHEN event_id % 8 IN (2, 3) THEN date_trunc('second', ts) ELSE date_trunc('hour', ts) END
       + to_minutes({sql_list(_SHIFT)}[(event_id % 8) + 1]), '%Y-%m-%d %H:%M:%S') END AS ts_text FROM events""")
def _parse_period(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("period", _period_text(F.col("ts")))
    return ev.select("event_id", utc_text(parse_period(F.col("period"))).alias("ts_text"))


_STAMPS = ("yyyy-MM-dd'T'HH:mm:ss'-00:00'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
           "yyyy-MM-dd HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'-07:00'", "dd.MM.yyyy")


@register("parse_price_ts", """SELECT event_id, CASE event_id % 7 WHEN 6 THEN NULL
  WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f')
  WHEN 5 THEN strftime(date_trunc('second', ts) + INTERVAL 7 HOUR, '%Y-%m-%d %H:%M:%S.%f')
  ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') END AS ts_text FROM events""")
def _parse_price_ts(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    text = F.lit(None).cast("string")
    for i, pattern in enumerate(_STAMPS):
        text = F.when(F.pmod("event_id", F.lit(7)) == i, F.date_format("ts", pattern)).otherwise(text)
    return ev.select("event_id", F.date_format(parse_price_ts(text), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"))


_NUMBERS = ("{v}", " {v} ", "-{v}", "{v}e2", "null", "N/A", "--", "", "1d", "NaN", "Infinity", "1_000", "abc", "+{v}")


def _number_text():
    out = F.lit(None).cast("string")
    for i, shape in enumerate(_NUMBERS):
        out = F.when(F.pmod("event_id", F.lit(len(_NUMBERS))) == i,
                     F.replace(F.lit(shape), F.lit("{v}"), F.col("value").cast("string"))).otherwise(out)
    return out


_NUMBER_SQL = """CASE event_id % 14 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN -value WHEN 3 THEN CAST(CAST(value AS VARCHAR) || 'e2' AS DOUBLE)
  WHEN 13 THEN value END"""


@register("parse_numeric", f"SELECT event_id, coalesce({_NUMBER_SQL}, -9999) AS number FROM events")
def _parse_numeric(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("t", _number_text())
    return ev.select("event_id", F.coalesce(parse_numeric(F.col("t")), F.lit(-9999.0)).alias("number"))


@register("parse_price", f"""SELECT event_id, CASE WHEN {_NUMBER_SQL} IS NULL THEN 'invalid_price' ELSE 'ok' END AS state FROM events""")
def _parse_price(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("t", _number_text())
    return ev.select("event_id", F.when(parse_price(F.col("t")).isNull(), "invalid_price").otherwise("ok").alias("state"))


@register("parse_opt_int", f"SELECT event_id, coalesce(CAST(trunc({_NUMBER_SQL}) AS INTEGER), -9999) AS number FROM events")
def _parse_opt_int(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("t", _number_text())
    return ev.select("event_id", F.coalesce(parse_opt_int(F.col("t")), F.lit(-9999)).alias("number"))


@register("series_id", f"""SELECT event_id, 'EBA.' || {sql_nth(CODES, 'user_id')} || '-ALL.' || {sql_nth(METRICS, 'event_id')} || '.H' AS series_id FROM events""")
def _series_id(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", series_id(nth(CODES, F.col("user_id")),
                                           F.lower(nth(METRICS, F.col("event_id")))).alias("series_id"))


@register("equivalent_mw", f"""WITH e AS (SELECT event_id, value, {sql_nth(UNITS, 'event_id')} AS unit FROM events)
SELECT event_id, unit <> 'thousand cubic feet' AS hourly_energy,
  CASE WHEN unit <> 'thousand cubic feet' THEN value ELSE -1 END AS mw FROM e""")
def _equivalent_mw(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("unit", nth(UNITS, F.col("event_id")))
    return ev.select("event_id", is_hourly_energy_unit(F.col("unit")).alias("hourly_energy"),
                     F.coalesce(equivalent_mw(F.col("value"), F.col("unit")), F.lit(-1.0)).alias("mw"))


@register("observation_age", f"""SELECT event_id, round(date_diff('microsecond', ts, TIMESTAMP '{AS_OF}') / 3600000000.0, 4) AS age_hours,
  date_diff('microsecond', ts, TIMESTAMP '{AS_OF}') > 72 * 3600000000 AS stale FROM events""")
def _observation_age(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    ts, as_of = F.col("ts").cast("timestamp"), F.lit(AS_OF).cast("timestamp")
    return ev.select("event_id", F.round(age_hours(ts, as_of), 4).alias("age_hours"),
                     is_stale(ts, as_of).alias("stale"))
