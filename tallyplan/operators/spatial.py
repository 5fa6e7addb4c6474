"""Spatial joins over a grid: equality on plan and cell, then the exact predicate; no pair is tested twice or emitted twice."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyplan.functions.geometry import Box, intersection

#: Cells are much larger than boxes, so that few boxes lie in more than one and what is shuffled is little more than the boxes.
CELL = 256


def _celled(boxes: DataFrame, cell: int, pad: tuple[int, int]) -> DataFrame:
    """A row for each cell that a box meets; ``corner`` has bit 1 in its first column of cells and bit 2 in its first row. Boxes
    without a place are in no cell, so that the sides are never null; saying so halves the code that is generated for a pair."""
    first = lambda at, by: F.floor((F.col(at) - by) / cell)
    cells = lambda at, size, by: F.sequence(first(at, by), F.floor((F.col(at) + F.col(size) + by) / cell))
    rows = boxes.withColumn("cx", F.explode(cells("x", "w", pad[0]))).withColumn("cy", F.explode(cells("y", "h", pad[1])))
    corner = F.when(F.col("cx") == first("x", pad[0]), 1).otherwise(0) + F.when(F.col("cy") == first("y", pad[1]), 2).otherwise(0)
    return rows.withColumns({"corner_": F.coalesce(corner, F.lit(0)).cast("tinyint"), **{c: F.coalesce(c, F.lit(0)) for c in "xywh"}})


def _sided(boxes: DataFrame, suffix: str, keys: list[str]) -> DataFrame:
    return boxes.select(*(F.col(c).alias(c if c in keys else f"{c}{suffix}") for c in boxes.columns))


def spatial_join(a: DataFrame, b: DataFrame, predicate: Callable[[Box, Box], Column], on: list[str], cell: int | None = None, pad: int | tuple[int, int] = 0, prepare: Callable[[DataFrame, list[str]], DataFrame] = lambda rows, keys: rows) -> DataFrame:
    """Pairs of boxes within ``pad`` of one another (one for both axes, or one for each) that satisfy the predicate; columns
    get the suffixes _a and _b. Cells grow with the pad unless ``cell`` says how large they are.

    Each pair is kept only in the cell that holds the corner where their (padded) overlap begins, so there is no distinct: the
    cell that is the first of one of them in both directions. That and four comparisons of sides come before the predicate.
    A relation joined with itself has half of the pad on either side, so that both sides are the same rows and shuffled once.
    ``prepare`` may add columns to the rows of each side, whose cells are given by the keys.
    """
    pads = pad if isinstance(pad, tuple) else (pad, pad)
    cell = cell or CELL + 2 * max(pads)
    keys = [*on, "cx", "cy"]
    pad_a, pad_b = [tuple(-(-p // 2) for p in pads)] * 2 if a is b else (pads, (0, 0))
    left, right = (_sided(prepare(_celled(side, cell, by), keys), suffix, keys) for side, by, suffix in ((a, pad_a, "_a"), (b, pad_b, "_b")))
    box_a, box_b = Box("_a"), Box("_b")
    owner = F.col("corner__a").bitwiseOR(F.col("corner__b")) == 3
    return left.join(right, keys).where(owner & _meeting(box_a, box_b, pads) & predicate(box_a, box_b)).drop("cx", "cy", "corner__a", "corner__b")


def _meeting(a: Box, b: Box, pads: tuple[int, int]) -> Column:
    return (a.x - b.x <= b.w + pads[0]) & (b.x - a.x <= a.w + pads[0]) & (a.y - b.y <= b.h + pads[1]) & (b.y - a.y <= a.h + pads[1])


def self_pairs(boxes: DataFrame, predicate: Callable[[Box, Box], Column], on: list[str], identity: str, cell: int | None = None) -> DataFrame:
    """Unordered pairs of one relation, the smaller identity first."""
    return spatial_join(boxes, boxes, lambda a, b: (F.col(f"{identity}_a") < F.col(f"{identity}_b")) & predicate(a, b), on, cell)


def spatial_semi(a: DataFrame, b: DataFrame, predicate: Callable[[Box, Box], Column], on: list[str], identity: str, anti: bool = False, cell: int | None = None, pad: int | tuple[int, int] = 0) -> DataFrame:
    hit = spatial_join(a.select(identity, *on, "x", "y", "w", "h"), b, predicate, on, cell, pad).select(F.col(f"{identity}_a").alias(identity)).distinct()
    return a.join(hit, identity, "left_anti" if anti else "left_semi")


def summarised(boxes: DataFrame, others: DataFrame, predicate: Callable[[Box, Box], Column], on: list[str], keep: list[str], aggregates: list[Column], pad: int = 0) -> DataFrame:
    """``keep`` of every box, with aggregates over the others within ``pad`` of it that satisfy the predicate; boxes have the suffix
    _a there, others _b. A box without any stays, and its aggregates see one row of nulls. Equal boxes are not made one.

    A box of half a cell at most is dealt once, to the cell of its corner, and summed up there: the others go to all cells in which
    the corner of such a box may lie. So boxes are neither copied nor joined with their sums. Larger boxes go to all of their cells.
    """
    cell = CELL + 2 * pad
    reach, keys, pads = cell // 2, [*on, "cx", "cy"], (pad, pad)
    placed = (F.col("x") + F.col("y") + F.col("w") + F.col("h")).isNotNull()
    large = placed & (F.greatest("w", "h") > reach)
    at = lambda name, by: F.floor((F.col(name) + by) / cell)
    around = lambda name, size: F.explode(F.sequence(at(name, -reach - pad), at(name, F.col(size) + pad)))
    numbered = boxes.withColumn("row_", F.monotonically_increasing_id())

    def summed(mine: DataFrame, theirs: DataFrame, first: Column, by: list[str]) -> DataFrame:
        a, b = Box("_a"), Box("_b")
        same_cell = reduce(Column.__and__, (F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys))
        pairs = _sided(mine, "_a", []).join(_sided(theirs, "_b", []), same_cell & first & _meeting(a, b, pads) & predicate(a, b), "left")
        sums = pairs.groupBy(*(F.col(f"{c}_a").alias(c) for c in dict.fromkeys([*keep, *by, "row_"]))).agg(*aggregates)
        return sums.drop(*({*by, "row_"} - {*keep}))

    once = numbered.where(~large).withColumns({"cx": F.when(placed, at("x", 0)), "cy": F.when(placed, at("y", 0)), **{c: F.coalesce(c, F.lit(0)) for c in "xywh"}})
    reached = others.withColumn("cx", around("x", "w")).withColumn("cy", around("y", "h")).withColumns({c: F.coalesce(c, F.lit(0)) for c in "xywh"})
    owner = F.col("corner__a").bitwiseOR(F.col("corner__b")) == 3
    rest = summed(_celled(numbered.where(large), cell, pads), _celled(others, cell, (0, 0)), owner, [])
    return summed(once, reached, F.lit(True), keys).unionByName(rest)


def overlapping(a: Box, b: Box) -> Column:
    return intersection(a, b) > 0


def strips_around(zone: Box, width: int, height: int) -> dict[str, tuple[Column, Column, Column, Column]]:
    """What a page has above, below, left and right of a row's zone; the first two are as wide as the page."""
    right, bottom, none, wide = zone.x + zone.w, zone.y + zone.h, F.lit(0), F.lit(width)
    return {"above": (none, none, wide, zone.y), "below": (none, bottom, wide, height - bottom), "left": (none, zone.y, zone.x, zone.h), "right": (right, zone.y, width - right, zone.h)}


def outside(width: int, height: int, x: int, y: int, w: int, h: int) -> list[tuple[int, int, int, int]]:
    """The strips of an image around a zone: above, below, left, right; empty ones are left out."""
    strips = [(0, 0, width, y), (0, y + h, width, height - y - h), (0, y, x, h), (x + w, y, width - x - w, h)]
    return [s for s in strips if s[2] > 0 and s[3] > 0]


def excluded(zones: list[tuple[int, int, int, int]], share_percent: int = 10) -> Column:
    """More than ``share_percent`` of the smaller of box and zone is shared, for any of a request's few zones."""
    box, out = Box(), F.lit(False)
    for zone in zones:
        other = Box(columns=tuple(F.lit(v) for v in zone))
        out = out | ((intersection(box, other) > 0) & (intersection(box, other) * 100 > F.least(box.area, other.area) * share_percent))
    return out
