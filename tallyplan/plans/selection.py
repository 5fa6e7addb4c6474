"""Which of several hits in one place stay."""

from pyspark.sql import functions as F

from tallyplan.functions import geometry as G
from tallyplan.operators import rules, selection as S
from tallyplan.operators.spatial import CELL, self_pairs
from tallyplan.plans.base import query
from tallyplan.plans.rules import COLOR_CLASSES, measured

#: Larger symbols that take the place of a part, by the part's number.
PARENTS = {6: (7,), 9: (7,), 11: (10, 12)}


def ranked(spark, d, *order):
    """Hits as boxes in an order that is total."""
    return measured(spark, d).withColumn("id", F.col("hit_id")).withColumn("rank", F.struct(*order, "hit_id"))


def by_match(spark, d):
    return ranked(spark, d, -F.col("match"))


def by_quality(spark, d):
    return ranked(spark, d, -F.col("verif"), -F.col("match"), -F.col("coverage"), -F.col("purity"), "y", "x", "area", "template_id")


def kept(ids):
    return ids.select(F.col("id").alias("hit_id"))


@query("nms_greedy")
def nms_greedy(spark, d):
    """Non-maximum suppression per template on plans of at least 250 hits: best first, none with an IoU over .85 with a kept one."""
    boxes = by_match(spark, d).select("id", "rank", "plan_id", "template_id", "x", "y", "w", "h")
    return kept(S.suppress(boxes, ["plan_id", "template_id"], 85, 250, ["plan_id"]))


def dominance(pairs):
    """Whether the better-placed side _a of a pair in one place suppresses side _b."""
    a, b = (lambda c: F.col(f"{c}_a")), (lambda c: F.col(f"{c}_b"))
    better = lambda c, by: a(c) >= b(c) + by
    parent = F.lit(False)
    for child, parents in PARENTS.items():
        parent = parent | ((b("template_id") == child) & a("template_id").isin(*parents))
    # The margins by which a symbol suppresses another.
    promoted = parent & (a("verif") >= 68) & (a("area") * 10 >= b("area") * 11) & (a("verif") + 16 >= b("verif"))
    gray = (a("gray") == 1) & (b("gray") == 1)
    fuller = gray & (a("text") == 0) & (b("text") == 0) & (a("area") * 100 >= b("area") * 155) & (a("coverage") >= 94) & (a("purity") >= 40) & (a("verif") + 8 >= b("verif"))
    plain = F.col("first_a") & (a("verif") * 1000 >= b("verif") * 1000 + 6500) & better("match", 9) & better("coverage", 8)
    close_size = gray & (a("text") == 0) & (b("text") == 0) & (F.greatest(a("area"), b("area")) * 100 <= F.least(a("area"), b("area")) * 125)
    finer = a("purity") * 10 >= b("purity") * 10 + 25
    return F.when(a("template_id") == b("template_id"), F.col("first_a")).otherwise(promoted | fuller | (plain & (~close_size | finer)))


def dominating(boxes):
    """(winner, loser, w, l) with the ranks of both. Pairs in one place are few: they are met once, dealt out and turned into both
    directions before these are judged, so that a pair of the join is tested for its place alone."""
    met = self_pairs(boxes, G.clusters, ["plan_id"], "id", cell=CELL // 2).repartition("plan_id", "id_a")
    directed = lambda p, q: F.struct(*(F.col(f"{c}{s}").alias(f"{c}{t}") for s, t in ((p, "_a"), (q, "_b")) for c in boxes.columns if c != "plan_id"))
    pairs = met.select(F.explode(F.array(directed("_a", "_b"), directed("_b", "_a"))).alias("p")).select("p.*").withColumn("first_a", F.col("rank_a") < F.col("rank_b"))
    return pairs.where(dominance(pairs)).select(F.col("id_a").alias("winner"), F.col("id_b").alias("loser"), F.col("rank_a").alias("w"), F.col("rank_b").alias("l"))


SIDE = ["id", "rank", "plan_id", "template_id", "x", "y", "w", "h", "area", "gray", "text", "verif", "match", "coverage", "purity"]


@query("local_winners_greedy")
def local_winners_greedy(spark, d):
    """Winners of their place: the best first; a better-explained larger symbol that comes later evicts those it dominates."""
    boxes = by_quality(spark, d).select(*SIDE)
    return kept(S.evicting_scan(boxes, dominating(boxes)))


@query("raw_dedupe")
def raw_dedupe(spark, d):
    """Near-identical hits of one template once, but for up to three scales of a gray symbol in one place."""
    boxes = by_match(spark, d).select("id", "rank", "plan_id", "template_id", "x", "y", "w", "h", "gray", "scale")
    return kept(S.raw_duplicates(boxes, ["plan_id", "template_id"]))


@query("raw_local_alternatives")
def raw_local_alternatives(spark, d):
    """At most sixteen gray hits of one template, source and mask in one place."""
    near = lambda a, b: (G.intersection(a, b) * 100 >= F.least(a.area, b.area) * 72) & (G.distance2_squared(a, b) * 10_000 <= F.least(a.diagonal_squared, b.diagonal_squared) * 4 * 484)
    boxes = by_match(spark, d).where("gray = 1").select("id", "rank", "plan_id", "template_id", "source", "x", "y", "w", "h")
    return kept(S.alternatives_within(boxes, ["plan_id", "template_id", "source"], 16, near))


@query("search_windows_coalesced")
def search_windows_coalesced(spark, d):
    """Search windows around hits, without those that a kept larger one holds to .92."""
    wide = measured(spark, d).select(F.col("hit_id").alias("id"), "plan_id", (F.col("x") - F.col("ink_share")).alias("x"), (F.col("y") - 20).alias("y"), (F.col("w") + 2 * F.col("ink_share")).alias("w"), (F.col("h") + 40).alias("h"))
    boxes = wide.withColumn("rank", F.struct(-(F.col("w") * F.col("h")), "x", "y", "id"))
    return kept(S.contained(boxes, ["plan_id"], 92))


def same_object(a, b):
    return (G.intersection(a, b) > 0) & ((G.intersection(a, b) * 100 >= G.union_area(a, b) * 30) | (G.intersection(a, b) * 100 >= F.least(a.area, b.area) * 60))


@query("satellites")
def satellites(spark, d):
    """Compact colour hits that are no same object as a plan's winners, nor as a better satellite."""
    boxes = by_quality(spark, d)
    # the winners here are each template's best hit on its plan
    best = boxes.groupBy("plan_id", "template_id").agg(F.min_by("id", "rank").alias("id")).select("id")
    compact = boxes.where(rules.holds(COLOR_CLASSES, "compact_satellite")).join(best, "id", "left_anti").select("id", "rank", "plan_id", "x", "y", "w", "h")
    return kept(S.apart_from(compact, boxes.join(best, "id", "left_semi").select("id", "plan_id", "x", "y", "w", "h"), same_object, ["plan_id"]))


@query("seed_groups")
def seed_groups(spark, d):
    """Hits of one family gathered around seeds within 48 pixels."""
    boxes = by_quality(spark, d).where("template_id between 5 and 12").select("id", "rank", "plan_id", "x", "y", "w", "h")
    close = lambda a, b: G.distance2_squared(a, b) <= 4 * 24 * 24
    return S.seeded_groups(boxes, close, ["plan_id"]).select(F.col("id").alias("hit_id"), "seed")
