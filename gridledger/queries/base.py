"""Registration of queries and the inputs Spark derives from the given tables."""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridledger.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Name a query and the SQL that must give the same rows."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str, rows: int = 20_000) -> DataFrame:
    """Columns of a table for work that is heavy for each row, dealt by ``key`` to tasks of about ``rows`` rows.

    A Parquet file is read by one task for each row group, so a table of a million short rows may be one task. Windows and
    joins on ``key`` need no further shuffle.
    """
    df = table(spark, sf_dir, name)
    return df.select(key, *columns).repartition(max(1, math.ceil(df.count() / rows)), key)


def sql_text(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def sql_list(values: Sequence) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_rows(rows: Sequence[Sequence]) -> str:
    return ", ".join("(" + ", ".join(sql_text(v) for v in row) + ")" for row in rows)


def rules_cte(name: str, rules) -> str:
    """CTE ``name(label, ord, term)`` of a vocabulary."""
    rows = [(label, i, term) for i, (label, terms) in enumerate(rules) for term in terms]
    return f"{name}(label, ord, term) AS (VALUES {sql_rows(rows)})"


def nth(values: Sequence[str], index: Column) -> Column:
    """Element ``index mod n`` of a literal list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def sql_nth(values: Sequence[str], index: str) -> str:
    return f"{sql_list(values)}[(({index}) % {len(values)}) + 1]"


AS_OF = "2024-01-04 02:30:00"  # 3 January in the market zone

# Energy phrases appended to the conversation texts, so that every label of the
# classifiers occurs somewhere in the questions.
PHRASES = (
    "What was the day-ahead NP15 price yesterday?",
    "Is Diablo Canyon running at full capacity right now?",
    "Show ERCOT load forecast for today",
    "Why did Henry Hub gas price spike this week? pipeline outage",
    "latest FERC tariff filing on transmission planning",
    "PJM net generation latest",
    "solar curtailment and wind forecast in California",
    "Brent crude oil price and OPEC supply outlook",
    "battery storage capacity and state of charge",
    "MISO total interchange on 2023-07-04",
    "thermal coal stockpile and coal generation",
    "carbon allowance price under cap-and-trade, RGGI",
    "green hydrogen project construction permit",
    "heat wave and cold snap weather in Texas",
    "company earnings merger acquisition asset sale",
    "real-time SP-15 LMP in 2022",
    "SPP south hub congestion binding constraint shadow price",
    "NYISO demand in New York",
    "ISO-NE load New England",
    "what happened with the forced outage at the unit",
    "gasoline diesel refinery crack spread",
    "reserve margin and operating reserves, energy emergency",
    "TTF gas storage injection in Europe",
    "Palo Verde reactor status",
    "ZP26 fifteen minute FMM settlement",
    "please tell me about something else entirely",
    "the fuel question",
    "login page register sign in",
    "Freeport LNG exports, mmbtu and bcf",
    "mid-C hydro BPA western interconnection",
    "Alberta AESO power price",
    "commission order, policy legislation subsidy",
    "TH_NP15_GEN-APND and np15 and SP15 node prices",
    "interconnection queue rate case reliability standard NERC",
    "CAISO demand forecast",
    "ERCOT net imports",
    "southwest power pool generation mix",
    "national energy statistics for the United States",
    "SoCalGas citygate, pg&e citygate, ofo",
    "path 26 transformer line outage flowgate",
)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per conversation turn: its whole text plus an energy phrase."""
    conv = table(spark, sf_dir, "conversations")
    ident = F.col("conv_id") * 100 + F.col("turn")
    return conv.select(
        ident.alias("question_id"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(" "),
                 nth(PHRASES, F.col("conv_id") * 7 + F.col("turn"))).alias("question"),
        F.lit(AS_OF).cast("timestamp").alias("as_of"))


QUESTIONS_SQL = f"""questions AS (
  SELECT conv_id * 100 + turn AS question_id,
         coalesce(text, '') || ' ' || {sql_nth(PHRASES, 'conv_id * 7 + turn')} AS question
  FROM conversations)"""

NORM_SQL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
# white space in the oracle's regular expressions
SP = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def norm_sql(column: str) -> str:
    return NORM_SQL.format(column)


def squeeze_sql(column: str) -> str:
    return f"trim(regexp_replace({column}, '{SP}+', ' ', 'g'))"


def utc_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(c: Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)
