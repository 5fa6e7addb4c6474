"""Histograms of whole-number channels as partial aggregates, and exact percentiles read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histograms(rows: DataFrame, keys: list[str], channels: list[str]) -> DataFrame:
    """(keys, channel, value, n): how often each value stands in each channel. Nulls don't count.

    Counts are added up before the shuffle, so a key has as many rows as its channels have values, however many pixels it has;
    tables of different pieces merge by adding counts.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("channel"), F.col(c).cast("long").alias("value")) for c in channels)))
    return rows.select(*keys, pairs.alias("p")).select(*keys, "p.channel", "p.value").where("value is not null").groupBy(*keys, "channel", "value").agg(F.count("*").alias("n"))


def percentiles(table: DataFrame, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """(keys, channel, total, a column for each share): percentiles between neighbouring values, as all pixels in order give."""
    group = Window.partitionBy(*keys, "channel")
    ordered = table.withColumns({"upto": F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(group)})
    out = []
    for name, share in shares.items():
        at = (F.col("total") - 1) * share
        low = F.min(F.when(F.col("upto") > F.floor(at), F.col("value")))
        high = F.min(F.when(F.col("upto") > F.ceil(at), F.col("value")))
        part = F.max(at - F.floor(at))
        out.append((low + (high - low) * part).alias(name))
    return ordered.groupBy(*keys, "channel").agg(F.max("total").alias("total"), *out)
