"""Price selection, coverage and day summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.text import is_lmp_component
from gridledger.functions.times import day_end_utc, day_start_utc, expected_intervals, local_day

DAY_KEYS = ("location", "market", "market_date")


def missing_field() -> Column:
    """The required field that a row lacks, null for a row that has all."""
    return (F.when(F.col("location").isNull(), "missing_location")
            .when(F.col("market").isNull(), "missing_market")
            .when(F.col("component").isNull(), "missing_component"))


def reject_files(rows: DataFrame, file: str) -> DataFrame:
    """Files in which any row lacks its location, market or component. Only such rows are grouped."""
    return (rows.select(file, missing_field().alias("reject_reason")).where("reject_reason is not null")
            .groupBy(file).agg(F.max("reject_reason").alias("reject_reason")))


def row_fault() -> Column:
    return (F.when(F.col("start_ts").isNull() | F.col("end_ts").isNull(), "invalid_timestamp")
            .when(F.col("end_ts") <= F.col("start_ts"), "invalid_interval")
            .when(F.col("price_value").isNull(), "invalid_price"))


def keyed_rows(rows: DataFrame, zone: str, fault: Column) -> DataFrame:
    """Price-component rows under their day keys, compared without case."""
    return (rows.where(is_lmp_component(F.col("component")))
            .withColumns({"location": F.upper("location"), "market": F.upper("market"),
                          "market_date": local_day(F.col("start_ts"), zone), "bad_row": fault}))


def select_lmp_rows(rows: DataFrame, zone: str = fv.PRICE_ZONE, file: str | None = None) -> DataFrame:
    """Price-component rows keyed by hub, market and local market day.

    All rows of a file that lacks a required field somewhere (in any component) are marked
    with the reason. Rows without a ``file`` column are one file.

    A row with an unreadable boundary, an end not after its start or an unusable price
    stays, marked, because it invalidates the day it belongs to (an unreadable start leaves
    the day unknown).
    """
    if file is None:
        refused = rows.select(F.max(missing_field()).alias("_refused")).scalar()
        return keyed_rows(rows, zone, F.coalesce(refused, row_fault()))
    refused = reject_files(rows, file).select(file, F.col("reject_reason").alias("_refused"))
    return keyed_rows(rows.join(refused, file, "left"), zone, F.coalesce("_refused", row_fault())).drop("_refused")


def with_window(df: DataFrame, zone: str = fv.PRICE_ZONE) -> DataFrame:
    """UTC bounds and expected interval count of each market day."""
    df = df.withColumns({"utc_start": day_start_utc(F.col("market_date"), zone),
                         "utc_end": day_end_utc(F.col("market_date"), zone)})
    return df.withColumn("expected_count", expected_intervals(
        F.col("utc_start"), F.col("utc_end"), F.col("market")))


def summarize_days(intervals: DataFrame) -> DataFrame:
    """Row count, distinct starts, mean, min, max and the earliest extreme starts.

    Grouped by start first and by day second: both steps combine on the map
    side, so a day repeated a million times costs one row per start and task.
    """
    keys = list(DAY_KEYS)
    per_start = intervals.groupBy(*keys, "start_ts").agg(
        F.count("*").alias("n"), F.sum("price_value").alias("total"),
        F.min("price_value").alias("low"), F.max("price_value").alias("high"),
        F.min("bad_row").alias("bad"))
    start, epoch = F.col("start_ts"), F.col("start_ts").cast("double")
    return per_start.groupBy(*keys).agg(
        F.sum("n").alias("row_count"), F.count("*").alias("actual_count"),
        (F.sum("total") / F.sum("n")).alias("average_price"),
        F.min("low").alias("minimum_price"), F.max("high").alias("maximum_price"),
        F.min_by(start, F.struct("low", "start_ts")).alias("minimum_start"),
        F.max_by(start, F.struct(F.col("high"), (-epoch).alias("e"))).alias("maximum_start"),
        F.min("bad").alias("bad_row"))


def coverage(row_count: Column, actual: Column, expected: Column, bad: Column) -> Column:
    """A row fault, duplicate, misaligned, incomplete or complete."""
    return (
        F.when(bad.isNotNull(), bad)
        .when(row_count > actual, "duplicate")
        .when(expected.isNull(), "misaligned_window")
        .when(actual == expected, "complete")
        .otherwise("incomplete"))


def coverage_status(summaries: DataFrame) -> DataFrame:
    return summaries.withColumn("coverage", coverage(
        F.col("row_count"), F.col("actual_count"), F.col("expected_count"), F.col("bad_row")))


def days_of_hubs(keyed: DataFrame, zone: str) -> DataFrame:
    """Summary and coverage of keyed rows; a row without a known day faults all days of its hub and market."""
    days = summarize_days(keyed.where("location is not null and market is not null"))
    lost = F.when(F.col("market_date").isNull(), F.col("bad_row"))
    fault = F.min(lost).over(Window.partitionBy("location", "market"))
    days = days.withColumn("bad_row", F.coalesce(fault, F.col("bad_row"))).where("market_date is not null")
    return coverage_status(with_window(days, zone))


def price_day_summary(rows: DataFrame, zone: str = fv.PRICE_ZONE, file: str | None = None,
                      asked: DataFrame | None = None) -> DataFrame:
    """One row per hub, market and local day with its coverage, in one pass.

    A row whose start cannot be read belongs to no known day and faults all days
    of its hub and market; that look-up runs over the few summarised rows. Days
    touched by a refused ``file`` carry its reason (rows without one are one file). ``asked`` (the day
    keys) limits the summary to those days before anything is grouped; ``PriceDays`` reads no others.
    """
    chosen = select_lmp_rows(rows, zone, file)
    if asked is not None:
        hubs = asked.select("location", "market", F.lit(None).cast("date").alias("market_date"))
        keys = asked.select(*DAY_KEYS).unionByName(hubs).distinct().toDF(*(f"_{k}" for k in DAY_KEYS))
        match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in DAY_KEYS]
        chosen = chosen.join(keys, match, "left_semi")
    return days_of_hubs(chosen, zone)


class PriceDays:
    """Price rows landed by market date, with a side table of the days that each file touches.

    A question about some days reads the folders of those days alone (dynamic partition pruning)
    and learns from the side table which of the files that touch them are refused.
    """

    ROWS, FILES = "rows", "files"

    def __init__(self, spark: SparkSession, folder: str, zone: str = fv.PRICE_ZONE) -> None:
        self.zone = zone
        self.rows = spark.read.parquet(f"{folder}/{self.ROWS}")
        self.files = spark.read.parquet(f"{folder}/{self.FILES}")

    @classmethod
    def land(cls, rows: DataFrame, folder: str, file: str, zone: str = fv.PRICE_ZONE, parts: int = 1) -> PriceDays:
        """Write typed rows: a folder per market date (``parts`` files each) and the files' days and faults."""
        spark = rows.sparkSession
        keyed = keyed_rows(rows, zone, row_fault()).withColumn("_file", F.col(file))
        kept = keyed.select("location", "market", "market_date", "start_ts", "price_value", "bad_row", "_file")
        spread = F.pmod(F.xxhash64("_file", "start_ts"), F.lit(parts))
        kept.repartition("market_date", spread).write.partitionBy("market_date").parquet(f"{folder}/{cls.ROWS}")
        days = rows.groupBy(F.col(file).alias("_file"), local_day(F.col("start_ts"), zone).alias("day")).agg(
            F.max(missing_field()).alias("reason"))
        days.write.parquet(f"{folder}/{cls.FILES}")
        return cls(spark, folder, zone)

    def refused(self, days: DataFrame | None = None) -> DataFrame:
        """(_file, _refused) of the refused files, or of those of them that touch some days (``market_date``) or an unknown one."""
        files = self.files
        if days is not None:
            touch = files.join(days.select(F.col("market_date").alias("day")).distinct(), "day", "left_semi")
            touch = touch.unionByName(files.where("day is null")).select("_file").distinct()
            files = files.where("reason is not null").join(touch, "_file", "left_semi")
        return (files.where("reason is not null").groupBy("_file").agg(F.max("reason").alias("_refused")))

    def summary(self, asked: DataFrame | None = None) -> DataFrame:
        """As ``price_day_summary``; with ``asked`` (the day keys) only the folders of those days are read, and that of no day."""
        if asked is None:
            return days_of_hubs(self._marked(self.rows, self.refused()), self.zone)
        # A comparison, though it only drops nulls: Catalyst prunes partitions for join sides that a comparison filters.
        keys = asked.where(F.col("market_date") > F.lit("0001-01-01").cast("date")).select(*DAY_KEYS).distinct()
        on_days = self.rows.join(keys, list(DAY_KEYS), "left_semi")
        lost = self.rows.where("market_date is null").join(keys.select("location", "market").distinct(), ["location", "market"], "left_semi")
        return days_of_hubs(self._marked(on_days.unionByName(lost), self.refused(keys)), self.zone)

    @staticmethod
    def _marked(rows: DataFrame, refused: DataFrame) -> DataFrame:
        return rows.join(refused, "_file", "left").withColumn("bad_row", F.coalesce("_refused", "bad_row"))


def summarize_prices(rows: DataFrame | PriceDays, queries: DataFrame, zone: str = fv.PRICE_ZONE, file: str | None = None) -> DataFrame:
    """Summary for each query (location, market, market_date); no rows is ``empty``.

    Only asked days are grouped, and summarised once; queries then meet one row per day, so a day that a
    third of all questions ask about is not summarised per question. Landed ``rows`` (``PriceDays``) are read for those days alone.
    """
    out = queries.join(asked_days(rows, queries.select(*DAY_KEYS), zone, file), list(DAY_KEYS), "left")
    return out.withColumn("coverage", F.coalesce("coverage", F.lit("empty")))


def asked_days(rows: DataFrame | PriceDays, asked: DataFrame, zone: str = fv.PRICE_ZONE, file: str | None = None) -> DataFrame:
    return rows.summary(asked) if isinstance(rows, PriceDays) else price_day_summary(rows, zone, file, asked)


def _table(column: Column, pairs: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in pairs:
        out = F.when(column == key, value).otherwise(out)
    return out


def display_hub(location: Column) -> Column:
    return _table(location, [(h[0], h[1]) for h in fv.HUBS])


def interval_name(market: Column) -> Column:
    return _table(market, [(m[0], m[4]) for m in fv.PRICE_MARKETS])


def report_name(market: Column) -> Column:
    return _table(market, [(m[0], m[2]) for m in fv.PRICE_MARKETS])


def price_answer_text(display: Column) -> tuple[Column, Column]:
    """Answer sentence and explanation of a day summary."""
    def money(name: str) -> Column:
        """Two decimals, half up on the value at six decimals."""
        return F.col(name).try_cast("decimal(38,6)").try_cast("decimal(38,2)").cast("string")

    direct = F.format_string("%s %s LMP averaged $%s/MWh on %s.", display, F.col("market"),
                             money("average_price"), F.date_format("market_date", "yyyy-MM-dd"))
    explain = F.format_string(
        "The official CAISO result contained %d validated intervals. The minimum was $%s/MWh and the"
        " maximum was $%s/MWh.", F.col("actual_count"), money("minimum_price"), money("maximum_price"))
    return direct, explain
