"""Ordered rules with reasons: the first rule that fails names the rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cascade(rows: DataFrame, rules: list[tuple[str, Column]], column: str = "reason") -> DataFrame:
    """Adds the name of the first rule whose condition holds, null where none does; later rules aren't evaluated for a row."""
    return rows.withColumn(column, F.coalesce(*(F.when(condition, F.lit(name)) for name, condition in rules)))


def verdict(rows: DataFrame, column: str = "reason") -> Column:
    return F.col(column).isNull()
