"""Comparing snapshots of boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyplan.functions import geometry as G
from tallyplan.operators import graph
from tallyplan.operators.lineage import stored
from tallyplan.operators.spatial import spatial_join, summarised

#: Cells in which centres meet. Boxes of one symbol are few on a plan, so cells are large and few boxes go to several.
CELL = 2048


def _near(a: G.Box, b: G.Box, distance: int, size: int) -> Column:
    return (G.distance2_squared(a, b) <= 4 * distance * distance) & (F.abs(a.w - b.w) <= size) & (F.abs(a.h - b.h) <= size)


def candidate_pairs(golden: DataFrame, candidate: DataFrame, on: list[str], distance: int, size: int) -> DataFrame:
    """Pairs of equal symbol whose centres are near and whose sizes agree, with four times their squared distance."""
    # boxes of one symbol are few on a plan, so cells are large and few boxes lie in several
    pairs = spatial_join(golden, candidate, lambda a, b: _near(a, b, distance, size), on, cell=1024, pad=distance)
    return pairs.select(F.col("box_id_a").alias("a"), F.col("box_id_b").alias("b"), G.distance2_squared(G.Box("_a"), G.Box("_b")).alias("cost"), *on)


def _met(golden: DataFrame, candidate: DataFrame, on: list[str], distance: int, size: int) -> tuple[DataFrame, DataFrame]:
    """The pairs of ``candidate_pairs``, with columns _a and _b of their boxes, and candidates without a pair in their cell. Golden boxes
    without a pair are among the pairs, without a ``cost``. Pairs are told that are ``chosen`` or may still be (``open``), and, where no pair of
    a box is chosen, the row that stands for it (``alone_a``, ``alone_b``).

    A golden box is dealt to the cell of its centre, a candidate to all cells in which the centre of such a box may lie. So a cell
    has all pairs of its golden boxes, and of the candidates that go to it alone, and a pair that is the nearest for both of its
    boxes is told there: pairs aren't shuffled, and both tables come from one shuffle of the snapshots if they are used in one run.
    A candidate of several cells is chosen by the rounds; it is ``home`` in the cell of its centre.
    """
    names, keys, reach = list(dict.fromkeys(["box_id", *on, *"xywh"])), [*on, "cx", "cy"], 2 * distance
    at = lambda center, by=0: F.floor((center + by) / (2 * CELL))
    around = lambda center: F.explode(F.sequence(at(center, -reach), at(center, reach)))
    a, b = G.Box("_a"), G.Box("_b")
    (ax, ay), (bx, by) = a.center2, b.center2
    # what joins ask of one of their sides is asked of both, and both have all columns everywhere, so that each is one exchange
    known = lambda s: reduce(Column.__and__, (F.col(f"{c}{s}").isNotNull() for c in names))
    named = lambda boxes, s: boxes.select(*(F.col(c).alias(f"{c}{s}") for c in names)).where(known(s))
    mine = named(golden, "_a").withColumns({"cx_a": at(ax), "cy_a": at(ay)}).where("cx_a is not null and cy_a is not null")
    theirs = named(candidate, "_b").withColumn("cx_b", around(bx)).withColumn("cy_b", around(by)).where("cx_b is not null and cy_b is not null")
    near = reduce(Column.__and__, (F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys)) & _near(a, b, distance, size)
    whole = reduce(Column.__and__, (at(c, -reach) == at(c, reach) for c in (bx, by)))
    home = reduce(Column.__and__, (F.col(k) == at(c) for k, c in (("cx_b", bx), ("cy_b", by))))

    cell, paired = [f"{k}_a" for k in keys], F.col("box_id_b").isNotNull()
    of_a, of_b = Window.partitionBy(*cell, "box_id_a"), Window.partitionBy(*cell, "box_id_b")
    key = F.when(paired, F.struct("cost", "box_id_a", "box_id_b"))
    pairs = mine.join(theirs, near, "left").withColumn("cost", G.distance2_squared(a, b))
    pairs = pairs.withColumn("first_a", key == F.min(key).over(of_a)).withColumn("first_b", key == F.min(key).over(of_b))
    pairs = pairs.withColumn("chosen", paired & F.col("first_a") & F.col("first_b") & whole)
    pairs = pairs.withColumn("gone", F.max("chosen").over(of_b)).withColumn("taken", F.max("chosen").over(of_a))
    pairs = pairs.withColumns({"open": paired & ~F.col("taken") & ~F.col("gone"), "alone_a": ~paired | (F.col("first_a") & ~F.col("taken")), "alone_b": paired & F.col("first_b") & ~F.col("gone") & home})
    lone = theirs.join(mine, near & (F.struct(F.lit(0), "box_id_a") != F.struct(F.lit(1), "box_id_b")), "left_anti")
    return pairs, lone.select(*(F.col(f"{c}_b").alias(c) for c in names), home.alias("home"), whole.alias("whole"))


def match_snapshots(golden: DataFrame, candidate: DataFrame, on: list[str], distance: int = 18, size: int = 12) -> DataFrame:
    """(a, b, cost, on...): one-to-one matching, nearest first. Only pairs that aren't the nearest for both go to the rounds."""
    pairs, _ = _met(golden, candidate, on, distance, size)
    pairs = stored(pairs.where("chosen or open").select(F.col("box_id_a").alias("a"), F.col("box_id_b").alias("b"), "cost", *(F.col(f"{c}_a").alias(c) for c in on), "chosen"))
    return pairs.where("chosen").drop("chosen").union(graph.greedy_matching(pairs.where("not chosen").drop("chosen")))


def nearest_conflicts(golden: DataFrame, candidate: DataFrame, on: list[str], distance: int) -> DataFrame:
    """For each golden box the nearest candidate of another symbol."""
    other = lambda a, b: (F.col("symbol_a") != F.col("symbol_b")) & (G.distance2_squared(a, b) <= 4 * distance * distance)
    pairs = spatial_join(golden, candidate, other, on, pad=distance)
    best = F.min(F.struct(G.distance2_squared(G.Box("_a"), G.Box("_b")).alias("d2"), F.col("box_id_b").alias("box_id"), F.col("symbol_b").alias("symbol")))
    return pairs.groupBy(F.col("box_id_a").alias("golden_id")).agg(best.alias("m")).select("golden_id", F.col("m.box_id").alias("candidate_id"), F.col("m.symbol").alias("symbol"))


def sentinel_counts(sentinels: DataFrame, boxes: DataFrame, reach: int, radius: int, share_percent: int) -> DataFrame:
    """``sentinels(id, plan_id, mode, x, y, w, h, symbols, near)`` with n, the boxes at their place that have one of their symbols
    (any, for allow_any_near). A place is a region, within ``reach`` of which a box's centre lies or of which it shares
    enough, or a point, within ``radius`` of which its corner lies."""

    def there(s: G.Box, b: G.Box):
        wide = s.expanded(reach)
        region = G.center_within(b, wide) | (G.intersection(b, wide) * 100 >= F.least(b.area, wide.area) * share_percent)
        point = (b.x - s.x) * (b.x - s.x) + (b.y - s.y) * (b.y - s.y) <= radius * radius
        symbol = (F.col("mode_a") == "allow_any_near") | F.array_contains("symbols_a", F.col("template_id_b"))
        return symbol & F.when(F.col("near_a"), point).otherwise(region)

    n = spatial_join(sentinels, boxes, there, ["plan_id"], cell=128, pad=max(reach, radius)).groupBy(F.col("id_a").alias("id")).agg(F.count("*").alias("n"))
    return sentinels.join(n, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def report(golden: DataFrame, candidate: DataFrame, distance: int = 18, size: int = 12, conflict: int = 20) -> DataFrame:
    """(plan_id, box_id, side, status) of every box: matched or moved pairs by the golden box, what is missing or extra, and
    missing boxes with another symbol in their place as conflicts."""
    on, sized = ["plan_id", "symbol"], ["symbol", *"xywh"]
    pairs, lone = _met(golden, candidate, on, distance, size)
    # of a chosen pair's boxes, the id of one and its plan are all that is told
    place = lambda s: F.struct(*(F.col(f"{c}{s}").alias(c) for c in sized))
    of_box = lambda s: F.when(F.col(f"alone{s}"), place(s))
    pairs = pairs.where("chosen or open or alone_a or alone_b").select(F.col("plan_id_a").alias("plan_id"), F.col("box_id_a").alias("a"), F.when(~F.col("chosen"), F.col("box_id_b")).alias("b"), "cost", "chosen", "open", of_box("_a").alias("alone_a"), of_box("_b").alias("alone_b"))
    lone = lone.select("plan_id", F.col("box_id").alias("b"), place("").alias("alone_b"), "home", "whole")
    nowhere = reduce(Column.__or__, (F.col(c).isNull() for c in ("box_id", *on, *"xywh")))
    unplaced = [boxes.where(nowhere).select("plan_id", F.col("box_id").alias(end), place("").alias(f"alone_{end}")) for boxes, end in ((golden, "a"), (candidate, "b"))]
    seen = stored(reduce(lambda p, q: p.unionByName(q, allowMissingColumns=True), [pairs, lone, *unplaced]))
    rest = graph.greedy_matching(seen.where("open").select("a", "b", "cost", "plan_id"))
    matched = seen.where("chosen").select("plan_id", "a", "cost").union(rest.select("plan_id", "a", "cost"))
    matched = matched.select("plan_id", F.col("a").alias("box_id"), F.lit("golden").alias("side"), F.when(F.col("cost") == 0, "matched").otherwise("moved").alias("status"))

    def left(end: str, unsure: Column) -> DataFrame:
        alone = seen.where(F.col(f"alone_{end}").isNotNull() & F.coalesce("home", F.lit(True)))
        box = ["plan_id", F.col(end).alias("box_id"), f"alone_{end}.*"]
        met = graph.cut(alone.where(unsure).select(box).join(rest.select(F.col(end).alias("box_id")), "box_id", "left_anti"))
        return alone.where(~unsure).select(box).unionByName(met)

    paired = F.col("cost").isNotNull()
    missing, extra = left("a", paired), left("b", paired | ~F.coalesce("whole", F.lit(True)))
    other = lambda a, b: (F.col("symbol_a") != F.col("symbol_b")) & (G.distance2_squared(a, b) <= 4 * conflict * conflict)
    gone = summarised(missing, extra, other, ["plan_id"], ["plan_id", "box_id"], [F.count("box_id_b").alias("met")], conflict)
    gone = gone.select("plan_id", "box_id", F.lit("golden").alias("side"), F.when(F.col("met") > 0, "conflict").otherwise("missing").alias("status"))
    return matched.unionByName(gone).unionByName(extra.select("plan_id", "box_id", F.lit("candidate").alias("side"), F.lit("extra").alias("status")))


def gate(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per plan the numbers of missing, extra and conflicting boxes, and whether all are zero."""
    counts = report(golden, candidate).groupBy("plan_id").agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("missing", "extra", "conflict")))
    return counts.withColumn("ok", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("conflict") == 0))
