"""Where hits go: a bitmap of stages carried through a chain, the stage that lost each hit, and what is left near a region."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyplan.functions.geometry import Box
from tallyplan.operators.lineage import cut
from tallyplan.operators.spatial import spatial_join


class First(NamedTuple):
    """A stage that keeps the first ``most`` hits of each group, in an order that is total."""

    keys: list[str]
    most: int
    order: list[str]


#: A stage is a condition on a hit, the first of groups, or takes the hits that are left and returns those that it keeps, by their identity.
Stage = tuple[str, "Column | First | Callable[[DataFrame], DataFrame]"]


def marked(hits: DataFrame, stages: list[Stage], identity: str) -> DataFrame:
    """All ``hits`` with ``bits``, in which bit k says that a hit is there after stage k. Each stage sees what the ones before it left.

    Conditions are marked in place and the first of groups by one window, so that only a stage of another kind joins the hits
    with what it keeps; these are cut by a checkpoint beforehand, for it reads them twice.
    """
    state = hits.withColumn("bits", F.lit(0).cast("long"))
    for k, (_, keeps) in enumerate(stages):
        alive, bit = F.col("bits") == (1 << k) - 1, F.lit(1 << k).cast("long")
        if isinstance(keeps, First):
            place = F.row_number().over(Window.partitionBy(alive, *map(F.expr, keeps.keys)).orderBy(*map(F.expr, keeps.order)))
            state = state.withColumn("place", place).withColumn("bits", F.when(alive & (F.col("place") <= keeps.most), F.col("bits") + bit).otherwise(F.col("bits"))).drop("place")
        elif isinstance(keeps, Column):
            state = state.withColumn("bits", F.when(alive & keeps, F.col("bits") + bit).otherwise(F.col("bits")))
        else:
            state = cut(state)
            kept = keeps(state.where(alive).drop("bits")).select(F.col(identity), bit.alias("bit"))
            state = state.join(kept, identity, "left").withColumn("bits", F.col("bits") + F.coalesce("bit", F.lit(0))).drop("bit")
    return state


def through(hits: DataFrame, stages: list[Stage], identity: str) -> tuple[DataFrame, dict[str, int]]:
    """``marked`` hits, cut by a checkpoint, and how many each stage leaves, observed on the way."""
    seen = Observation()
    there = [F.count_if(F.col("bits").bitwiseAND((2 << k) - 1) == (2 << k) - 1).alias(f"n{k}") for k in range(len(stages))]
    state = marked(hits, stages, identity)
    state = cut(state.observe(seen, *there) if stages else state)
    return state, {name: seen.get[f"n{k}"] for k, (name, _) in enumerate(stages)}


def lost_at(bits: Column, stages: int) -> Column:
    """The number of the stage that lost a hit: how many bits are set from the lowest on; null if all are."""
    first = F.bit_count(bits.bitwiseXOR(bits + 1)) - 1
    return F.when(first < stages, first)


def near_regions(state: DataFrame, regions: DataFrame, stages: int, radius: int, most: int, order: list[Column], identity: str) -> DataFrame:
    """(plan_id, region, stage, matched, items): for every region ``(plan_id, region, x, y, w, h)`` and stage the hits that are
    there after it within ``radius`` of the region, and the first ``most`` of them by distance and ``order``."""
    wide = regions.select("plan_id", "region", "x", "y", "w", "h")
    far = lambda p, q: _gap_squared(p, q) <= radius * radius
    met = spatial_join(wide, state, far, ["plan_id"], pad=radius)
    met = met.select("plan_id", F.col("region_a").alias("region"), _gap_squared(Box("_a"), Box("_b")).alias("far"), F.col("bits_b").alias("bits"), F.col(f"{identity}_b").alias("id"), *(c.alias(f"o{k}") for k, c in enumerate(order)))
    each = met.withColumn("stage", F.explode(F.sequence(F.lit(0), F.lit(stages - 1)))).where("shiftright(bits, stage) & 1 = 1")
    key = ["plan_id", "region", "stage"]
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("far", *(f"o{k}" for k in range(len(order))), "id"))
    top = each.withColumns({"turn": turn, "matched": F.count("*").over(Window.partitionBy(*key))}).where(F.col("turn") <= most)
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id"))), lambda x: x["id"]), ",")
    return top.groupBy(*key).agg(F.max("matched").alias("matched"), items.alias("items"))


def _gap_squared(region: Box, hit: Box) -> Column:
    """Squared distance between a region and a hit; 0 if they overlap or touch."""
    dx = F.greatest(F.lit(0), region.x - hit.x - hit.w, hit.x - region.x - region.w)
    dy = F.greatest(F.lit(0), region.y - hit.y - hit.h, hit.y - region.y - region.h)
    return dx * dx + dy * dy
