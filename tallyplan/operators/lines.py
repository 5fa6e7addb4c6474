"""Lines of whole plans from runs of ink, their crossings, and the cells of the lattice that they make."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyplan.functions.geometry import Box
from tallyplan.operators import tiles as T
from tallyplan.operators.graph import connected_components
from tallyplan.operators.lineage import cut
from tallyplan.operators.spatial import spatial_join

#: Runs of so many pixels make lines, gaps of so many are closed; fixed values.
LONG = 40
GAP = 5


def runs(pieces: DataFrame, side: int = T.SIDE) -> DataFrame:
    """(plan_id, r, c0, c1) of the horizontal runs of ink in each tile; c1 is the column after the last."""

    def compute(w: T.Window) -> tuple[np.ndarray, ...]:
        rows, starts, ends = T._runs(w.mask)
        return np.full(len(rows), w.plan_id), rows + w.r0, starts + w.c0, ends + w.c0

    return T.tilewise(pieces, "plan_id long, r long, c0 long, c1 long", compute, side)


def joined(intervals: DataFrame, gap: int) -> DataFrame:
    """(plan_id, r, c0, c1) of intervals of a row, those at most ``gap`` apart made one; a row has no more than its columns."""
    row = Window.partitionBy("plan_id", "r").orderBy("c0", "c1")
    far = F.max("c1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    new = intervals.withColumn("new", F.when(F.col("c0") - far <= gap, 0).otherwise(1))
    return new.withColumn("of", F.sum("new").over(row)).groupBy("plan_id", "r", "of").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1")).drop("of")


def horizontal_lines(pieces: DataFrame, long: int = LONG, gap: int = GAP, side: int = T.SIDE) -> DataFrame:
    """(plan_id, line, x, y, w, h) of horizontal lines: runs put together over the tiles' borders, opened by ``long`` pixels, gaps
    of up to ``gap`` closed, and those that touch in neighbouring rows made one line, named by its first pixel.

    Opening comes first, so that a row of dots or letters is no line however small its gaps are.
    """
    opened = joined(runs(pieces, side), 0).where(F.col("c1") - F.col("c0") >= long)
    rows = cut(joined(opened, gap).select("plan_id", "r", "c0", "c1", (F.shiftleft("plan_id", 40) + F.shiftleft("r", 20) + F.col("c0")).alias("id")))
    above = rows.select("plan_id", (F.col("r") + 1).alias("r"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("id").alias("a"))
    edges = above.join(rows, ["plan_id", "r"]).where("a0 <= c1 and c0 <= a1").select("a", F.col("id").alias("b"))
    named = rows.join(connected_components(edges), F.col("id") == F.col("node"), "left").withColumn("line", F.coalesce("component", "id"))
    out = named.groupBy("plan_id", "line").agg(F.min("c0").alias("x"), F.min("r").alias("y"), F.max("c1").alias("right"), F.max("r").alias("last"))
    return out.select("plan_id", "line", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("last") - F.col("y") + 1).alias("h"))


def vertical_lines(pieces: DataFrame, long: int = LONG, gap: int = GAP, side: int = T.SIDE) -> DataFrame:
    """The same of vertical lines; they are named by their first pixel's column and row."""
    turned = horizontal_lines(T.transposed(pieces), long, gap, side)
    return turned.select("plan_id", "line", F.col("y").alias("x"), F.col("x").alias("y"), F.col("h").alias("w"), F.col("w").alias("h"))


def crossings(horizontal: DataFrame, vertical: DataFrame, slack: int = GAP, arm: int = 8) -> DataFrame:
    """(plan_id, h_line, v_line, x, y, left, right, up, down): where a horizontal and a vertical line meet, ends up to ``slack``
    short of the other counting as met, and on which sides a line goes on for ``arm`` pixels or more."""
    wide = horizontal.select("plan_id", F.col("line").alias("id"), (F.col("x") - slack).alias("x"), (F.col("y") - slack).alias("y"), (F.col("w") + 2 * slack).alias("w"), (F.col("h") + 2 * slack).alias("h"))
    high = vertical.select("plan_id", F.col("line").alias("id"), "x", "y", "w", "h")
    a, b = Box("_a"), Box("_b")
    met = spatial_join(wide, high, lambda p, q: (p.x < q.x + q.w) & (q.x < p.x + p.w) & (p.y < q.y + q.h) & (q.y < p.y + p.h), ["plan_id"])
    x, y = F.floor(b.x + b.w / 2), F.floor(a.y + a.h / 2)
    return met.select(
        "plan_id", F.col("id_a").alias("h_line"), F.col("id_b").alias("v_line"), x.alias("x"), y.alias("y"), (x - (a.x + slack) >= arm).alias("left"), (a.x + a.w - slack - x >= arm).alias("right"), (y - b.y >= arm).alias("up"), (b.y + b.h - y >= arm).alias("down")
    )


def lattice_cells(crossed: DataFrame) -> DataFrame:
    """(plan_id, x, y, w, h) of the cells between crossings: from a corner where lines go right and down, along the upper line to
    the next crossing that a line leaves downwards, along the left line to the next one that a line leaves to the right, if
    these two lines meet in a corner that has lines up and to the left. Cells may span columns or rows of their neighbours."""
    point = ["plan_id", "h_line", "v_line", "x", "y"]
    along = Window.partitionBy("plan_id", "h_line").orderBy("x", "v_line")
    down = Window.partitionBy("plan_id", "v_line").orderBy("y", "h_line")
    upper = crossed.where("down").select(*point, "right", F.lead(F.struct("v_line", "x", "left")).over(along).alias("east"))
    beside = crossed.where("right").select(*point, F.lead(F.struct("h_line", "y", "up")).over(down).alias("south"))
    corner = upper.where("right and east.left").join(beside.where("south.up"), point)
    wanted = corner.select("plan_id", F.col("south.h_line").alias("h_line"), F.col("east.v_line").alias("v_line"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("east.x").alias("x1"), F.col("south.y").alias("y1"))
    closed = crossed.where(F.col("up") & F.col("left")).select("plan_id", "h_line", "v_line")
    out = wanted.join(closed, ["plan_id", "h_line", "v_line"]).select("plan_id", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    return out.where("w > 0 and h > 0")
