"""A chain of preferences over the members of a place: each step may hand the place to another member, seeing what the last left."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reads a measure of a member.
Reader = Callable[[str], Column]


class Step(NamedTuple):
    """``pool`` says which members contend with the winner, ``order`` ranks them (the highest first), and ``accept`` whether the
    best of them takes the place; all read a member's and the winner's measures."""

    name: str
    pool: Callable[[Reader, Reader], Column]
    order: Callable[[Reader], list[Column]]
    accept: Callable[[Reader, Reader], Column] = lambda h, w: F.lit(True)


def winners(members: DataFrame, place: list[str], identity: str, order: list[Column], steps: list[Step]) -> DataFrame:
    """(place, identity of the winner, why): the best member by ``order``, then every step in turn; ``why`` names the steps that
    changed the winner, joined by commas. The smaller identity wins ties.

    All steps are windows over one partitioning by place, so members are shuffled once however long the chain is, and a
    place's rows are never an array.
    """
    window = Window.partitionBy(*place)
    names = [c for c in members.columns if c not in place]
    rows = members.withColumn("me", F.struct(*names)).select(*place, *(c.alias(f"o{k}") for k, c in enumerate(order)), "me")
    firsts = [f"o{k}" for k in range(len(order))]
    rows = rows.withColumn("win", F.min_by("me", F.struct(*firsts, f"me.{identity}")).over(window)).withColumn("why", F.array().cast("array<string>")).select(*place, "me", "win", "why")
    for step in steps:
        mine, won = (lambda c: F.col(f"me.{c}")), (lambda c: F.col(f"win.{c}"))
        contends = (mine(identity) != won(identity)) & step.pool(mine, won)
        rank = F.struct(*(-c for c in step.order(mine)), mine(identity))
        rows = rows.withColumn("best", F.min_by(F.when(contends, F.col("me")), F.when(contends, rank)).over(window))
        best = lambda c: F.col(f"best.{c}")
        takes = F.col("best").isNotNull() & step.accept(best, won)
        rows = rows.withColumn("takes", F.coalesce(takes, F.lit(False)))
        rows = rows.select(*place, "me", F.when(F.col("takes"), F.col("best")).otherwise(F.col("win")).alias("win"), F.when(F.col("takes"), F.concat("why", F.array(F.lit(step.name)))).otherwise(F.col("why")).alias("why"))
    return rows.where(F.col(f"me.{identity}") == F.col(f"win.{identity}")).select(*place, F.col(f"win.{identity}").alias(identity), F.array_join("why", ",").alias("why"))
