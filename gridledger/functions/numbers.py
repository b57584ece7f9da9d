"""Numeric parsing that never raises."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridledger.functions.text import strip

# Plain decimal or scientific notation; excludes suffixes such as 1d and words
# such as NaN that a cast alone would accept.
_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_price(c: Column) -> Column:
    """Finite double or null (the caller turns null into a reject reason)."""
    number = F.regexp_extract(strip(c), _DECIMAL, 0).try_cast("double")
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def parse_numeric(c: Column) -> Column:
    """As ``parse_price``; the null words (``NULL_TOKENS``) are no decimals either."""
    return parse_price(c)


def parse_opt_int(c: Column) -> Column:
    """Integer through double, truncated toward zero; null when unusable."""
    return F.regexp_extract(strip(c), _DECIMAL, 0).try_cast("double").try_cast("int")


def round_half_up(c: Column, digits: int = 3) -> Column:
    """Half up on the value at nine decimals, so summation noise cannot flip a tie."""
    return F.round(c.try_cast("decimal(38,9)"), digits).cast("double")
