"""Ranking, quotas and budgets; every order is total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], k: int, protected: Column | None = None) -> DataFrame:
    """The first k of each group, and every protected row beyond. Without protected rows the limit is pushed below the sort."""
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.where((F.col("_rank") <= k) | protected if protected is not None else F.col("_rank") <= k).drop("_rank")


def budget(rows: DataFrame, variant: list[str], template: list[str], order: list[Column], per_variant: int, per_template: int, reserved: int, total: int, scope: list[str]) -> DataFrame:
    """Chained limits: per variant, per template, then per scope over what isn't reserved. The first ``reserved`` rows of a
    template always stay, so the total is a soft limit."""
    first = top_per_group(rows, variant, order, per_variant)
    ranked = first.withColumn("_t", F.row_number().over(Window.partitionBy(*template).orderBy(*order))).where(F.col("_t") <= per_template)
    held = ranked.where(F.col("_t") <= reserved)
    rest = ranked.where(F.col("_t") > reserved)
    counted = held.groupBy(*scope).agg(F.count("*").alias("_held"))
    left = rest.withColumn("_r", F.row_number().over(Window.partitionBy(*scope).orderBy(*order))).join(counted, scope, "left")
    return held.drop("_t").unionByName(left.where(F.col("_r") <= total - F.coalesce("_held", F.lit(0))).drop("_t", "_r", "_held"))


def running_quota(rows: DataFrame, region: list[str], variant: list[str], order: list[Column], per_region: int, quota: int) -> DataFrame:
    """At most ``per_region`` of each region, taken in order of regions while the variant's quota lasts."""
    near = top_per_group(rows, [*variant, *region], order, per_region)
    spent = F.row_number().over(Window.partitionBy(*variant).orderBy(*region, *order))
    return near.withColumn("_n", spent).where(F.col("_n") <= quota).drop("_n")
