"""Search regions of whole plans: windows around ink, and foreground of rectangles across tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyplan.operators import tiles as T

# Fixed values of the search windows.
DILATE = 9
LEAST_PIXELS = 6
MOST_COMPONENTS = 1200
MERGE_GAP = 4
PADDING_PERCENT = 115
FULL_SCAN_PERCENT = 70

# Fixed values of the windows of gray plans.
GRAY_MOST_REGIONS = 360
GRAY_PADDING_PERCENT = 85
GRAY_CELL = 256
GRAY_PER_CELL = 2
GRAY_TILE_LEAST_INK = 12


def touching(a: np.ndarray, b: np.ndarray, gap: int) -> np.ndarray:
    """Whether rectangles (x, y, w, h) overlap or are within a gap of one another."""
    return (a[..., 0] + a[..., 2] + gap >= b[..., 0]) & (b[..., 0] + b[..., 2] + gap >= a[..., 0]) & (a[..., 1] + a[..., 3] + gap >= b[..., 1]) & (b[..., 1] + b[..., 3] + gap >= a[..., 1])


def merged(boxes: np.ndarray, gap: int) -> np.ndarray:
    """Bounds of rectangles that touch, again and again until none do; the result doesn't depend on their order."""
    while len(boxes) > 1:
        i, j = np.nonzero(np.triu(touching(boxes[:, None], boxes[None, :], gap), 1))
        if not len(i):
            break
        root = T._united(len(boxes), i, j)
        _, of = np.unique(root, return_inverse=True)
        low, high = np.full((of.max() + 1, 2), 1 << 40), np.full((of.max() + 1, 2), -1)
        np.minimum.at(low, of, boxes[:, :2])
        np.maximum.at(high, of, boxes[:, :2] + boxes[:, 2:])
        boxes = np.concatenate([low, high - low], axis=1)
    return boxes


def padded(x: Column, y: Column, w: Column, h: Column, pad_x: int, pad_y: int) -> list[Column]:
    """(x, y, w, h) widened on all sides, within the plan of the same row."""
    left, top = F.greatest(x - pad_x, F.lit(0)), F.greatest(y - pad_y, F.lit(0))
    return [left.alias("x"), top.alias("y"), (F.least(x + w + pad_x, F.col("columns").cast("long")) - left).alias("w"), (F.least(y + h + pad_y, F.col("rows").cast("long")) - top).alias("h")]


def search_regions(pieces: DataFrame, template_width: int, template_height: int, side: int = T.SIDE) -> DataFrame:
    """(plan_id, x, y, w, h, full) of the windows to search: components of the mask grown by 4 pixels, of 6 pixels or more,
    widened by 1.15 templates and merged while they touch. A plan is one full window if it has more than 1,200 components or
    its windows come to 70 % of its area. Plans without ink have no window.

    A group of windows to merge has 1,200 at most, by the rule itself.
    """
    pad_x, pad_y = (max(8, (size * PADDING_PERCENT + 50) // 100) for size in (template_width, template_height))
    parts = T.components(pieces, DILATE // 2, side)
    counted = parts.withColumn("n", F.count("*").over(Window.partitionBy("plan_id")))
    whole = F.array(F.lit(0).cast("long"), F.lit(0).cast("long"), F.col("columns").cast("long"), F.col("rows").cast("long"))
    crowded = counted.where(F.col("n") > MOST_COMPONENTS).groupBy("plan_id").agg(F.max("rows").alias("rows"), F.max("columns").alias("columns"))
    crowded = crowded.select("plan_id", whole.alias("b")).select("plan_id", *(F.col("b")[k].alias(c) for k, c in enumerate("xywh")), F.lit(True).alias("full"))
    few = counted.where((F.col("n") <= MOST_COMPONENTS) & (F.col("pixels") >= LEAST_PIXELS)).select("plan_id", "rows", "columns", *padded(*(F.col(c) for c in "xywh"), pad_x, pad_y))

    def run(table: pa.Table) -> pa.Table:
        plan, rows, columns = (table.column(c)[0].as_py() for c in ("plan_id", "rows", "columns"))
        boxes = merged(np.stack([table.column(c).to_numpy() for c in "xywh"], axis=1), MERGE_GAP)
        full = int((boxes[:, 2] * boxes[:, 3]).sum()) >= rows * columns * FULL_SCAN_PERCENT // 100
        if full:
            boxes = np.array([[0, 0, columns, rows]])
        return pa.table({"plan_id": pa.array([plan] * len(boxes), pa.int64()), **{c: pa.array(boxes[:, k], pa.int64()) for k, c in enumerate("xywh")}, "full": pa.array([full] * len(boxes))})

    kind = "plan_id long, x long, y long, w long, h long, full boolean"
    return few.groupBy("plan_id").applyInArrow(run, kind).unionByName(crowded)


def foreground(pieces: DataFrame, boxes: DataFrame, side: int = T.SIDE) -> DataFrame:
    """``boxes(plan_id, x, y, w, h)`` with the ink in each, as ``ink``: a box is cut by tiles, a tile's summed-area table gives
    each part's sum, and sums of the parts add up. Equal boxes are one row."""
    part = "plan_id long, tile_r long, tile_c long, x long, y long, w long, h long, bits binary, th int, tw int"
    wanted = boxes.select("plan_id", *(F.col(c).cast("long").alias(c) for c in "xywh")).where("w > 0 and h > 0").distinct()
    over = lambda at, size: F.explode(F.sequence(F.floor(F.greatest(F.col(at), F.lit(0)) / side), F.floor((F.col(at) + F.col(size) - 1) / side)))
    spread = wanted.withColumn("tile_r", over("y", "h")).withColumn("tile_c", over("x", "w"))
    drawn = T.tiles(pieces, side).select("plan_id", F.floor(F.col("r") / side).alias("tile_r"), F.floor(F.col("c") / side).alias("tile_c"), "bits", F.col("h").alias("th"), F.col("w").alias("tw"))
    both = spread.unionByName(drawn, allowMissingColumns=True).select(*(f.split()[0] for f in part.split(", ")))

    def run(table: pa.Table) -> pa.Table:
        drawn = table.filter(pa.compute.is_valid(table.column("bits")))
        asked = table.filter(pa.compute.is_null(table.column("bits")))
        n = len(asked)
        box = np.stack([asked.column(c).to_numpy() for c in "xywh"], axis=1).astype(np.int64) if n else np.zeros((0, 4), np.int64)
        ink = np.zeros(n, dtype=np.int64)
        if n and len(drawn):
            tile = drawn.slice(0, 1).to_pylist()[0]
            mask = T.unpacked(tile["bits"], tile["th"], tile["tw"])
            table_ = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), dtype=np.int64)
            table_[1:, 1:] = mask.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
            clip = lambda v, size: np.clip(v, 0, size)
            x0, x1 = (clip(v - tile["tile_c"] * side, mask.shape[1]) for v in (box[:, 0], box[:, 0] + box[:, 2]))
            y0, y1 = (clip(v - tile["tile_r"] * side, mask.shape[0]) for v in (box[:, 1], box[:, 1] + box[:, 3]))
            ink = table_[y1, x1] - table_[y0, x1] - table_[y1, x0] + table_[y0, x0]
        return pa.table({"plan_id": asked.column("plan_id"), **{c: pa.array(box[:, k], pa.int64()) for k, c in enumerate("xywh")}, "ink": pa.array(ink, pa.int64())})

    sums = both.groupBy("plan_id", "tile_r", "tile_c").applyInArrow(run, "plan_id long, x long, y long, w long, h long, ink long")
    return sums.groupBy("plan_id", "x", "y", "w", "h").agg(F.sum("ink").alias("ink"))


def _score(w: Column, h: Column, width: int, height: int) -> Column:
    """How unlike a template's box is: difference of the logarithms of area, and of aspect at .35."""
    area = F.abs(F.log((w * h + 1) / F.lit(float(width * height))))
    aspect = F.abs(F.log((w / F.greatest(h, F.lit(1)) + 0.05) / max(0.05, width / max(1, height))))
    return area + 0.35 * aspect


def gray_regions(pieces: DataFrame, template_width: int, template_height: int, side: int = T.SIDE, supplement: int = 0, reach: int = 0) -> DataFrame:
    """(plan_id, x, y, w, h, score, area) of the windows of gray plans: components of 6 pixels or more, widened by .85 templates
    and scored by their likeness to the template. A component larger than four templates a side, or eight in area, is searched
    by overlapping tiles with at least 12 pixels of ink. Each plan keeps 360: first the two best of each cell of 256 pixels, then
    the best of the rest; ``supplement`` more may come from cells that no window covers (or from any cell, of a score up to 2.4
    or 80 pixels), one a cell. Ties go by area, then place, so the order is total.
    """
    # fixed values: shares of a template for tiles and limits
    most_w, most_h = max(80, template_width * 4), max(80, template_height * 4)
    most_area = max(120, template_width * template_height * 8)
    pad_x, pad_y = (max(6, (size * GRAY_PADDING_PERCENT + 50) // 100) for size in (template_width, template_height))
    tile_w, tile_h = max(96, min(most_w, round(template_width * 3.2))), max(96, min(most_h, round(template_height * 3.2)))
    step_x, step_y = max(24, round(tile_w * 0.55)), max(24, round(tile_h * 0.55))
    parts = T.components(pieces, reach, side).where(F.col("pixels") >= LEAST_PIXELS)
    large = (F.col("pixels") > most_area) | (F.col("w") > most_w) | (F.col("h") > most_h)
    size = [F.col(c) for c in "xywh"]
    small = parts.where(~large).select("plan_id", *padded(*size, pad_x, pad_y), _score(F.col("w"), F.col("h"), template_width, template_height).alias("score"), F.col("pixels").alias("area"))
    wide = parts.where(large).select("plan_id", "rows", "columns", F.col("pixels").alias("area"), *padded(*size, pad_x, pad_y))
    starts = lambda at, extent, step: F.explode(F.sequence(F.col(at), F.col(at) + F.col(extent) - 1, F.lit(step).cast("long")))
    cut = wide.withColumn("tx", starts("x", "w", step_x)).withColumn("ty", starts("y", "h", step_y))
    cut = cut.select("plan_id", "area", F.col("tx").alias("x"), F.col("ty").alias("y"), F.least(F.lit(tile_w), F.col("columns") - F.col("tx")).cast("long").alias("w"), F.least(F.lit(tile_h), F.col("rows") - F.col("ty")).cast("long").alias("h"))
    inked = foreground(pieces, cut, side).where(F.col("ink") >= GRAY_TILE_LEAST_INK)
    tiled = cut.join(inked, ["plan_id", "x", "y", "w", "h"]).select("plan_id", *"xywh", (_score(F.col("w"), F.col("h"), template_width, template_height) + 0.12).alias("score"), F.least("area", "ink").alias("area"))
    every = small.unionByName(tiled).groupBy("plan_id", "x", "y", "w", "h").agg(F.min(F.struct("score", -F.col("area"))).alias("best"))
    every = every.select("plan_id", *"xywh", F.col("best.score").alias("score"), (-F.col("best.col2")).alias("area"))
    order = [F.col("score"), F.desc("area"), F.col("y"), F.col("x"), F.col("w"), F.col("h")]
    cell = lambda size: [F.floor((F.col("x") * 2 + F.col("w")) / (2 * size)), F.floor((F.col("y") * 2 + F.col("h")) / (2 * size))]
    ranked = every.withColumn("in_cell", F.row_number().over(Window.partitionBy("plan_id", *cell(GRAY_CELL)).orderBy(*order)))
    chosen = ranked.withColumn("turn", F.row_number().over(Window.partitionBy("plan_id").orderBy((F.col("in_cell") > GRAY_PER_CELL).cast("int"), *order)))
    kept = chosen.where(F.col("turn") <= GRAY_MOST_REGIONS)
    out = kept.select("plan_id", *"xywh", "score", "area")
    if not supplement:
        return out
    far = 384  # cells of the supplement, a fixed value
    named = [c.alias(n) for c, n in zip(cell(far), ("cell_x", "cell_y"), strict=True)]
    covered = kept.select("plan_id", *named).distinct().withColumn("covered", F.lit(True))
    rest = chosen.where((F.col("turn") > GRAY_MOST_REGIONS) & (F.col("area") >= 24)).select("plan_id", *"xywh", "score", "area", *named).join(covered, ["plan_id", "cell_x", "cell_y"], "left")
    rest = rest.where(F.col("covered").isNull() | (F.col("score") <= 2.4) | (F.col("area") >= 80))
    first = rest.withColumn("k", F.row_number().over(Window.partitionBy("plan_id", "cell_x", "cell_y").orderBy(*order))).where("k = 1")
    more = first.withColumn("turn", F.row_number().over(Window.partitionBy("plan_id").orderBy(*order))).where(F.col("turn") <= supplement)
    return out.unionByName(more.select("plan_id", *"xywh", "score", "area"))
