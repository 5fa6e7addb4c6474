"""Resolvers: decisions about a box from what stands near it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyplan.functions import geometry as G
from tallyplan.operators.selection import ordered_scan, pairs_without_copies
from tallyplan.operators.spatial import spatial_join


def better_sibling(boxes: DataFrame, family: Column, on: list[str], identity: str, score: str, margin: int, share_percent: int) -> DataFrame:
    """For each box of a family the best sibling in its place that beats it by more than the margin."""
    some = boxes.where(family)
    same = lambda a, b: (F.col(f"{identity}_a") != F.col(f"{identity}_b")) & (G.intersection(a, b) > 0) & (G.intersection(a, b) * 100 >= F.least(a.area, b.area) * share_percent) & (F.col(f"{score}_b") > F.col(f"{score}_a") + margin)
    pairs = spatial_join(some, some, same, on)
    return pairs.groupBy(F.col(f"{identity}_a").alias(identity)).agg(F.min_by(f"{identity}_b", F.struct(-F.col(f"{score}_b"), F.col(f"{identity}_b"))).alias("sibling"))


def promote(children: DataFrame, parents: DataFrame, on: list[str], identity: str, reach: int) -> DataFrame:
    """Children whose place, give or take ``reach`` pixels, a parent's frame holds; the closest parent wins."""
    holds = lambda a, b: (a.x >= b.x - reach) & (a.y >= b.y - reach) & (a.x + a.w <= b.x + b.w + reach) & (a.y + a.h <= b.y + b.h + reach)
    pairs = spatial_join(children, parents, holds, on, pad=reach)
    return pairs.groupBy(F.col(f"{identity}_a").alias("child")).agg(F.min_by(f"{identity}_b", F.struct(G.distance2_squared(G.Box("_a"), G.Box("_b")), f"{identity}_b")).alias("parent"))


def fair_peaks(peaks: DataFrame, on: list[str], most: int, apart: int) -> DataFrame:
    """The first ``most`` of ``peaks(id, rank, x, y, w, h)`` in each group: those that are apart from all better ones taken, in
    order, filled up with the best of the rest."""
    near = lambda a, b: (F.abs(a.x - b.x) < apart) & (F.abs(a.y - b.y) < apart)
    taken = ordered_scan(peaks, pairs_without_copies(peaks, near, on, pad=apart).select("first", "id", "copy"), F.count("*") > 0)
    marked = peaks.join(taken.withColumn("fair", F.lit(True)), "id", "left")
    place = F.row_number().over(Window.partitionBy(*on).orderBy(F.coalesce("fair", F.lit(False)).desc(), "rank"))
    return marked.withColumn("place", place).where(F.col("place") <= most).select("id", *on)
