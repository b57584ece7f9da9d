"""Reactor status reports: HTML tables and plain text to unit rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.text import norm_text, squeeze
from gridledger.sources.web import decode_entities

_TOKEN = r"(?is)<h[234]\b[^>]*>.*?</h[234]\s*>|<tr\b[^>]*>.*?</tr\s*>"
_CELL = r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"
_REGION = r"(?i)Region\s+(\d+)"
_LINE = r"^(.+?)\s*\|\s*(\d{1,3})$"


def _plain(html: Column) -> Column:
    return squeeze(decode_entities(F.regexp_replace(html, "<[^>]*>", " ")))


def _region(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, _REGION, 1), F.lit("")).cast("int")


def _carry(key: str) -> Column:
    """Latest region named above the current token of the same report."""
    return F.last("named", ignorenulls=True).over(
        Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))


def _usable(rows: DataFrame, key: str, headers: tuple[str, ...]) -> DataFrame:
    keep = (~norm_text(F.col("unit_name")).isin(*headers)
            & F.col("power_percent").between(0, fv.MAX_POWER_PERCENT))
    return rows.where(keep).select(key, "pos", "unit_name", "power_percent", "region")


def parse_reactor_tables(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Unit rows of status pages; the window is one report, never a shared key."""
    tokens = pages.select(key, F.posexplode(
        F.regexp_extract_all(html, F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    is_row = F.lower(F.substring("token", 1, 3)) == "<tr"
    cells = F.transform(F.regexp_extract_all("token", F.lit(_CELL), F.lit(1)), _plain)
    rows = tokens.select(
        key, "pos", is_row.alias("is_row"),
        F.when(~is_row, _region(_plain(F.col("token")))).alias("named"),
        F.when(is_row, cells).alias("cells"))
    rows = rows.withColumn("region", _carry(key)).where(F.col("is_row") & (F.size("cells") >= 2))
    power = F.nullif(F.regexp_extract(F.get("cells", F.lit(1)), r"-?\d+", 0), F.lit("")).try_cast("int")
    rows = rows.withColumns({"unit_name": F.get("cells", F.lit(0)), "power_percent": power})
    return _usable(rows, key, ("unit", "reactor"))


def parse_reactor_lines(texts: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """Unit rows of ``name | power`` lines; only an explicit bar separates."""
    lines = texts.select(key, F.posexplode(F.split(text, r"\r\n|[\n\r]")).alias("pos", "raw"))
    lines = lines.withColumn("line", squeeze(F.col("raw"))).where("line <> ''")
    lines = lines.withColumn("named", _region(F.col("line")))
    rows = lines.withColumn("region", _carry(key)).where(
        F.col("named").isNull() & F.col("line").rlike(_LINE))
    rows = rows.withColumns({
        "unit_name": squeeze(F.regexp_extract("line", _LINE, 1)),
        "power_percent": F.regexp_extract("line", _LINE, 2).cast("int")})
    return _usable(rows, key, ("unit", "power", "unit power"))
