"""Time and calendar expressions. Naive input is read as UTC."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridledger.functions import fixed_values as fv
from gridledger.functions.text import norm_text, strip

_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
_ZONE = r"(?:Z|[+-]\d{2}:\d{2})"
# Rewrites to one full ISO form, applied in order to the whole text.
_REWRITES = (
    (r"^(\d{4})(\d{2})(\d{2})(T|Z|$)", "$1-$2-$3$4"),
    (rf"^({_DAY})(?=Z|$)", "$1T00"),
    (r"([T ]\d{2})(\d{2})(?=\d{2}|Z|[+-]|$)", "$1:$2"),
    (r"([T ]\d{2}:\d{2})(\d{2})(?=Z|[+-]|$)", "$1:$2"),
    (r"([T ]\d{1,2})(?=Z|[+-]|$)", "$1:00"),
    (r"([T ]\d{1,2}:\d{1,2})(?=Z|[+-]|$)", "$1:00"),
    (r"([+-]\d{2})(\d{2})$", "$1:$2"),
    (rf"^({_DAY}[T ][\d:.]+)$", "$1Z"),
    (r"-00:00$", "Z"),
)
_SLASH = (r"^(\d{1,2})/(\d{1,2})/(\d{4}) ", "$3-$1-$2 ")
# The spellings that fill real extracts, rewritten without the whole chain.
_COMMON = ((r"^(\d{4})(\d{2})(\d{2})T(\d{2})Z?$", "$1-$2-$3T$4:00:00Z"),
           (r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})$", "$1Z"))
_FULL = rf"^({_DAY}[T ]\d{{1,2}}:\d{{1,2}}:\d{{1,2}}(?:\.\d{{1,9}})?{_ZONE})$"


def utc_timestamp(c: Column, slash_dates: bool = False) -> Column:
    """Timestamp from the accepted spellings, or null.

    A chain of rewrites to a full ISO text and a single cast, instead of trying
    each format in turn (every failed attempt would raise inside the JVM). Text
    that does not end in the full form extracts to '' and casts to null. The chain
    only runs where the common spellings did not already give a timestamp.
    """
    def rewritten(rules) -> Column:
        text = strip(c)
        for pattern, to in rules:
            text = F.regexp_replace(text, pattern, to)
        return F.regexp_extract(text, _FULL, 1).try_cast("timestamp")

    return F.coalesce(rewritten(_COMMON), rewritten(((_SLASH,) if slash_dates else ()) + _REWRITES))


def parse_period(c: Column) -> Column:
    """Observation period of an hourly series."""
    return utc_timestamp(c)


def parse_price_ts(c: Column) -> Column:
    """Interval boundary of a price extract (also US slash dates)."""
    return utc_timestamp(c, slash_dates=True)


_MONTH = ("(January|February|March|April|May|June|July|August|September|October|November|December"
          "|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept|Sep|Oct|Nov|Dec)")
_ISO_DAY = r"\b(20\d{2})-(\d{2})-(\d{2})\b"
_MONTH_FIRST = rf"(?i)\b(?=[JFMASOND]){_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s*(20\d{{2}})\b"
_DAY_FIRST = rf"(?i)\b(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MONTH}\s*,?\s*(20\d{{2}})\b"
_SLASH_DAY = r"\b(\d{1,2})/(\d{1,2})/(20\d{2})\b"


def month_number(name: Column) -> Column:
    """1..12 from an English month name or abbreviation, 0 when unknown."""
    start = F.lower(F.substring(name, 1, 3))
    return F.floor((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), start) + 2) / 3).cast("int")


def _date(year: Column, month: Column, day: Column) -> Column:
    text = F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"),
                    F.lpad(day, 2, "0"))
    return text.try_cast("date")


def market_date_form(c: Column, norm: Column | None = None) -> Column:
    """Which spelling of a date a question uses; the first listed form wins. ``norm`` is the question's
    ``norm_text`` where the caller has it."""
    text = norm_text(c) if norm is None else norm
    return (
        F.when(text.contains("day before yesterday"), "two_days_back")
        .when(text.contains("yesterday"), "yesterday")
        .when(text.contains("today"), "today")
        .when(c.rlike(_ISO_DAY), "iso")
        .when(c.rlike(_MONTH_FIRST), "month_first")
        .when(c.rlike(_DAY_FIRST), "day_first")
        .when(c.rlike(_SLASH_DAY), "slash")
        .otherwise("none")
    )


def resolve_market_date(c: Column, as_of: Column, zone: str = fv.PRICE_ZONE, norm: Column | None = None) -> Column:
    """Market date a question names; null when absent or not on the calendar."""
    text = norm_text(c) if norm is None else norm
    today = F.to_date(F.from_utc_timestamp(as_of, zone))

    def grab(pattern: str, i: int) -> Column:
        return F.regexp_extract(c, pattern, i)

    return (
        F.when(text.contains("day before yesterday"), F.date_sub(today, 2))
        .when(text.contains("yesterday"), F.date_sub(today, 1))
        .when(text.contains("today"), today)
        .when(c.rlike(_ISO_DAY), grab(_ISO_DAY, 0).try_cast("date"))
        .when(c.rlike(_MONTH_FIRST), _date(grab(_MONTH_FIRST, 3), month_number(grab(_MONTH_FIRST, 1)),
                                           grab(_MONTH_FIRST, 2)))
        .when(c.rlike(_DAY_FIRST), _date(grab(_DAY_FIRST, 3), month_number(grab(_DAY_FIRST, 2)),
                                         grab(_DAY_FIRST, 1)))
        .when(c.rlike(_SLASH_DAY), _date(grab(_SLASH_DAY, 3), grab(_SLASH_DAY, 1), grab(_SLASH_DAY, 2)))
    )


def market_date_status(c: Column, resolved: Column, norm: Column | None = None) -> Column:
    """resolved, missing_date or invalid_date."""
    return (
        F.when(resolved.isNotNull(), "resolved")
        .when(market_date_form(c, norm) == "none", "missing_date")
        .otherwise("invalid_date")
    )


def day_start_utc(day: Column, zone: str | Column = fv.PRICE_ZONE) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def day_end_utc(day: Column, zone: str | Column = fv.PRICE_ZONE) -> Column:
    """Start of the next local day, so clock-change days have 23 or 25 hours."""
    return F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone)


def local_day(ts: Column, zone: str | Column = fv.PRICE_ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def interval_minutes(market: Column) -> Column:
    out = F.lit(None).cast("int")
    for code, minutes, *_ in reversed(fv.PRICE_MARKETS):
        out = F.when(market == code, minutes).otherwise(out)
    return out


def expected_intervals(start: Column, end: Column, market: Column) -> Column:
    """Interval count of the window; null when it does not divide evenly."""
    minutes = F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 60).cast("long")
    step = interval_minutes(market)
    return F.when(F.pmod(minutes, step) == 0, (minutes / step).cast("int"))


def age_hours(ts: Column, as_of: Column) -> Column:
    return (as_of.cast("double") - ts.cast("double")) / 3600


def is_stale(ts: Column, as_of: Column, limit_hours: float = fv.STALE_AFTER_HOURS) -> Column:
    """Strictly older than the limit."""
    return age_hours(ts, as_of) > limit_hours


_REPORT = r"(?i)Report\s+for\s+([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})"
_MONTHS_FULL = ("january february march april may june july august september october november"
                " december").split()


def report_date(title: Column) -> Column:
    """Date of a "Report for Month D, YYYY" title, full month names only."""
    name = F.lower(F.regexp_extract(title, _REPORT, 1))
    return F.when(name.isin(*_MONTHS_FULL), _date(
        F.regexp_extract(title, _REPORT, 3), month_number(name), F.regexp_extract(title, _REPORT, 2)))


def iso_utc(ts: Column) -> Column:
    """ISO text with an explicit UTC offset."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
