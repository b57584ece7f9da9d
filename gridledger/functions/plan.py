"""Helpers that shape the logical plan."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters cannot re-expand.

    Catalyst pushes a filter through a projection by repeating the projected
    expression in the predicate. For text expressions referenced by dozens of
    conditions that means evaluating the same regular expression dozens of times
    per row. A one-element generator keeps the value as an attribute instead and
    stays inside generated code.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[expr.alias(name) for name, expr in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
