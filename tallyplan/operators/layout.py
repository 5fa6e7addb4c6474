"""Rows and bands: grouping of ordered positions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, group: list[str], at: str, tie: str, gap: float) -> DataFrame:
    """Adds ``island``: a new one begins where the distance to the row before exceeds the gap."""
    w = Window.partitionBy(*group).orderBy(at, tie)
    new = (F.col(at) - F.lag(at).over(w) > gap).cast("int")
    return rows.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def group_by_running_mean(values: Column, tolerance: float) -> Column:
    """Groups of a sorted array of numbers: a value joins the last group if it is within ``tolerance`` of that group's mean
    so far. An ordered fold, as each mean depends on what joined before. Returns structs (first, n, mean)."""
    one = lambda v: F.struct(v.alias("first"), F.lit(1).alias("n"), v.cast("double").alias("total"))
    empty = F.expr("cast(array() as array<struct<first:double,n:int,total:double>>)")

    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (F.abs(v - F.get(acc, F.size(acc) - 1)["total"] / F.get(acc, F.size(acc) - 1)["n"]) <= tolerance)
        grown = F.struct(last["first"].alias("first"), (last["n"] + 1).alias("n"), (last["total"] + v).alias("total"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(one(v))))

    return F.transform(F.aggregate(F.transform(values, lambda v: v.cast("double")), empty, step), lambda g: F.struct(g["first"].alias("first"), g["n"].alias("n"), (g["total"] / g["n"]).alias("mean")))


def running_mean_groups(rows: DataFrame, group: str, at: str, tolerance: float) -> DataFrame:
    """The same over rows, as (group, k, n, mean): each group's rows stream by in order, and one open group is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, k, n, total, started = None, 0, 0, 0.0, False
        for batch in batches:
            done: list[tuple] = []
            for owner, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if started and owner == key and abs(v - total / n) <= tolerance:
                    n, total = n + 1, total + v
                    continue
                if started:
                    done.append((key, k, n, total / n))
                k = k + 1 if started and owner == key else 0
                key, n, total, started = owner, 1, v, True
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else [()] * 4, (pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], [group, "k", "n", "mean"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((key, k, n, total / n), (pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], [group, "k", "n", "mean"])

    ordered = rows.where(F.col(at).isNotNull()).select(F.col(group).cast("long"), F.col(at).cast("double")).repartition(group).sortWithinPartitions(group, at)
    return ordered.mapInArrow(run, f"{group} long, k int, n int, mean double")


def row_bands(rows: DataFrame, group: list[str], center: str, pad: float) -> DataFrame:
    """Bands between the midpoints of neighbouring centres, padded at both ends."""
    w = Window.partitionBy(*group).orderBy(center)
    before, after = F.lag(center).over(w), F.lead(center).over(w)
    return rows.withColumn("top", F.coalesce((F.col(center) + before) / 2, F.col(center) - pad)).withColumn("bottom", F.coalesce((F.col(center) + after) / 2, F.col(center) + pad))


def best_window(rows: DataFrame, group: list[str], at: str, strong: Column, weight: Column, n: int) -> DataFrame:
    """The window of n rows with most strong rows, then most weight, then the earliest start, per group."""
    w = Window.partitionBy(*group).orderBy(at)
    inside = w.rowsBetween(0, n - 1)
    scored = rows.withColumns({"_n": F.count("*").over(inside), "strong_rows": F.sum(strong.cast("long")).over(inside), "total": F.sum(weight).over(inside)}).where(F.col("_n") == n)
    return scored.groupBy(*group).agg(F.min_by(F.struct(at, "strong_rows", "total"), F.struct(-F.col("strong_rows"), -F.col("total"), at)).alias("b")).select(*group, F.col(f"b.{at}").alias("start"), "b.strong_rows", "b.total")
