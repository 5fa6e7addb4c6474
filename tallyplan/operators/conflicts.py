"""Conflicts among colour symbols: stages that replace, add, relabel and drop final hits, each seeing what the last one left.

A hit has ``plan_id``, ``id``, ``template_id``, ``name`` and ``hue`` of its template, ``x``, ``y``, ``w``, ``h``, ``visual_h`` (the height of
its ink, or ``h``), ``source``, ``stroke`` (rejected as an elongated stroke) and measures in percent. A final hit has two more:
``place``, the id that it came in with, which stays when another hit takes its place, and ``stage``, what changed it last.
Where scores tie, the smaller id wins. Empty tables give empty results; a null hue is close to no hue.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyplan.functions import geometry as G
from tallyplan.functions.geometry import Box
from tallyplan.operators import selection
from tallyplan.operators.lineage import cut, stored
from tallyplan.operators.spatial import spatial_join

MEASURES = ("match", "verif", "coverage", "purity", "context", "content")
HIT = ("id", "template_id", "name", "hue", "x", "y", "w", "h", "visual_h", "source", "stroke", *MEASURES)

# Names of templates that take part in conflicts.
LONG = ("07_L7", "10_L10", "11_L11", "12_L12", "13_L13")
SHORT = ("08_L8", "09_L9")
WAVE = "28_TB11"
PANEL = "TB11"
FAMILY = r"^\d+_sym_\d+"
FAMILY_HUES = (135, 165)
LABELLED = r"^\d+_PEL\d+[A-Z]?$"
TEXT = "pdf_text"
RECLASS, LONG_RESCUE, WAVE_RESCUE, RELABEL = "template_family_reclass", "template_long_l_rescue", "template_wave_rescue", "template_label_disambiguation"
#: What a rescued or promoted hit has at least.
LEAST = {"verif": 58, "context": 24}
#: How many places a plan may gain from conflicts of hits that aren't final.
MOST_GAINED = 4

Stage = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def stage(mine: Callable[[], Column] | None = None, *reads: Callable[[], Column]) -> Callable[[Callable[..., DataFrame]], Stage]:
    """A stage from a ``part`` that gives what there is after it in place of ``mine``, the final hits that it may change or drop. The others
    stay as they are. ``reads`` are the other hits that it looks at. All are conditions; without one it is none of them."""
    none = lambda: F.lit(False)

    def made(part: Callable[..., DataFrame]) -> Stage:
        @wraps(part)
        def run(finals: DataFrame, hits: DataFrame | None = None, words: DataFrame | None = None, *more) -> DataFrame:
            return finals.where(~F.coalesce(run.mine(), none())).unionByName(part(finals, hits, words, *more))

        run.part, run.mine, run.reads = part, mine or none, reads
        return run

    return made


def is_family(name: Column, hue: Column) -> Column:
    return name.rlike(FAMILY) & hue.between(*FAMILY_HUES)


def as_finals(hits: DataFrame) -> DataFrame:
    return hits.select("plan_id", *HIT, F.col("id").alias("place"), F.lit(None).cast("string").alias("stage"))


def within(a: Box, b: Box, hundredths: Column | int) -> Column:
    """Whether the centres are at most this many hundredths of a pixel apart."""
    limit = F.lit(hundredths) if isinstance(hundredths, int) else hundredths
    return G.distance2_squared(a, b) * 10_000 <= limit * limit * 4


def shares(a: Box, b: Box, percent: int) -> Column:
    """Whether this share of the smaller box is common."""
    return G.intersection(a, b) * 100 >= F.least(a.area, b.area) * percent


def meet(a: DataFrame, b: DataFrame, predicate: Callable[[Box, Box], Column], reach: Column | int = 0, reach_b: Column | int = 0, cell: int = 128) -> DataFrame:
    """Pairs that satisfy the predicate, of boxes at most ``reach`` of the one and ``reach_b`` of the other apart."""

    def widened(df: DataFrame, by: Column | int) -> DataFrame:
        by = (F.lit(by) if isinstance(by, int) else F.ceil(by)).cast("long")
        own = {f"t{c}": F.col(c) for c in "xywh"}
        return df.withColumns({**own, "x": F.col("x") - by, "y": F.col("y") - by, "w": F.col("w") + 2 * by, "h": F.col("h") + 2 * by})

    own = lambda s: Box(columns=tuple(F.col(f"t{c}{s}") for c in "xywh"))
    pairs = spatial_join(widened(a, reach), widened(b, reach_b), lambda *_: predicate(own("_a"), own("_b")), ["plan_id"], cell=cell)
    names = [f"{c}{s}" for df, s in ((a, "_a"), (b, "_b")) for c in df.columns if c != "plan_id"]
    return pairs.select("plan_id", *(F.col(f"t{c}" if c[0] in "xywh" and c[1] == "_" else c).alias(c) for c in names))


def _hit_b() -> Column:
    return F.struct(*(F.col(f"{c}_b").alias(c) for c in HIT))


def take_over(finals: DataFrame, best: DataFrame, stage: str, source: str, accept: Column | None = None) -> DataFrame:
    """Places with a row of ``best(place, taken)`` take its hit, if ``accept`` holds."""
    takes = F.col("taken").isNotNull() & F.coalesce(F.lit(True) if accept is None else accept, F.lit(False))
    new = {c: F.col(f"taken.{c}") for c in HIT} | {c: F.greatest(F.col(f"taken.{c}"), F.lit(v)) for c, v in LEAST.items()} | {"source": F.lit(source)}
    out = [F.when(takes, new[c]).otherwise(F.col(c)).alias(c) for c in HIT]
    return finals.join(best, "place", "left").select("plan_id", *out, "place", F.when(takes, F.lit(stage)).otherwise(F.col("stage")).alias("stage"))


def gained(hits: DataFrame, stage: str, source: str | None = None) -> DataFrame:
    """A place for each hit, rescued if a source is named."""
    new = {c: F.col(c) for c in HIT}
    if source:
        new |= {c: F.greatest(F.col(c), F.lit(v)).alias(c) for c, v in LEAST.items()} | {"source": F.lit(source).alias("source")}
    return hits.select("plan_id", *new.values(), F.concat(F.lit(f"{stage}:"), "id").alias("place"), F.lit(stage).alias("stage"))


def without(finals: DataFrame, places: DataFrame) -> DataFrame:
    return finals.join(places.select(F.col("place_a").alias("place")).distinct(), "place", "left_anti")


def family_score(c: Callable[[str], Column]) -> Column:
    """Thousandths."""
    return 30 * c("verif") + 14 * c("match") + 9 * c("coverage") + 5 * c("purity") + 5 * c("context")


def _siblings() -> Column:
    return (F.col("source") != TEXT) & _family() & (F.col("coverage") >= 50) & (F.col("purity") >= 55) & (F.col("context") >= 20)


def _family() -> Column:
    return is_family(F.col("name"), F.col("hue"))


@stage(_family, _siblings)
def reclass_family(finals: DataFrame, hits: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """A place of the family goes to the best sibling of the same local symbol, if that is clearly better."""

    def same(a: Box, b: Box) -> Column:
        smallest = F.least(a.w, a.h, b.w, b.h)
        near = within(a, b, F.greatest(F.lit(2400), smallest * 48)) & shares(a, b, 22)
        return (G.intersection(a, b) > 0) & (shares(a, b, 55) | near | ((G.center_within(a, b) | G.center_within(b, a)) & shares(a, b, 35)))

    pairs = meet(finals.where(_family()), hits.where(_siblings()), same)
    best = pairs.groupBy(F.col("place_a").alias("place")).agg(F.min_by(_hit_b(), F.struct(-family_score(lambda c: F.col(f"{c}_b")), "id_b")).alias("taken"))
    itself = F.lit(True)
    for c in ("template_id", "x", "y", "w", "h"):
        itself = itself & (F.col(c) == F.col(f"taken.{c}"))
    better = family_score(lambda c: F.col(f"taken.{c}")) > family_score(F.col) + 120
    return take_over(finals.where(_family()), best, "family_reclassed", RECLASS, better & ~itself)


def _rivals() -> Column:
    return (F.col("source") != TEXT) & F.col("name").isin(*LONG) & (F.col("coverage") >= 55) & (F.col("purity") >= 62)


def _lost_waves() -> Column:
    strong = (F.col("verif") >= 55) | ((F.col("match") >= 56) & F.col("stroke"))
    return (F.col("source") != TEXT) & F.col("name").startswith(WAVE) & F.col("hue").isNotNull() & strong & (F.col("coverage") >= 80) & (F.col("purity") >= 55) & (F.col("context") >= 14)


@stage(None, _rivals, _lost_waves)
def rescue_waves(finals: DataFrame, hits: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Well covered waves without a final one in their place and without a better long symbol near come back, best first."""
    fit = hits.where(_lost_waves())
    stronger = lambda a, b: (shares(a, b, 8) | within(a, b, 8600)) & (F.col("match_b") >= F.greatest(F.lit(56), F.col("match_a") + 4))
    fit = fit.join(meet(fit, hits.where(_rivals()), stronger, 86).select(F.col("id_a").alias("id")).distinct(), "id", "left_anti")
    same = lambda a, b: shares(a, b, 42) | within(a, b, 1800)
    return gained(_best_apart(fit, finals, same, 18), "waves_rescued", WAVE_RESCUE)


def _best_apart(fit: DataFrame, finals: DataFrame, same: Callable[[Box, Box], Column], pad: int) -> DataFrame:
    """Hits that are no same object as a final one of their kind, nor as a better one of themselves."""
    on = ["plan_id", "template_id"]
    fit = cut(fit.withColumn("rank", F.struct(*(-F.col(c) for c in ("verif", "match", "coverage", "purity")), "id")))
    fit = cut(selection.clear_of(fit, finals, same, on, pad))
    return fit.join(selection.apart(fit, same, on, pad), "id", "left_semi")


def _strong_long() -> Column:
    """Some of the rivals."""
    slim = (F.greatest("w", "h") * 100 >= F.greatest(F.lit(1), F.least("w", "h")) * 245) & (F.least("w", "h") >= 32)
    return F.col("name").isin(*LONG) & (F.col("source") != TEXT) & (F.col("match") >= 60) & (F.col("coverage") >= 68) & (F.col("purity") >= 70) & (F.col("context") >= 35) & slim


def _local_long(waves: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """(key, taken): the best long symbol in conflict with each wave, where there is one."""
    place = lambda a, b: (G.intersection(a, b) > 0) & (shares(a, b, 40) | (within(a, b, 4200) & shares(a, b, 20)))
    own = (F.col("match_b") >= 62) & (F.col("coverage_b") >= 73) & (F.col("purity_b") >= 72) & (F.col("context_a") <= 32)
    pairs = meet(waves, hits.where(_strong_long()), place).where((F.col("match_b") >= F.col("match_a") + 6) | own)
    order = F.struct(*(-F.col(f"{c}_b") for c in ("match", "coverage", "purity", "context", "verif")), "id_b")
    return pairs.groupBy(F.col(f"{key}_a").alias(key)).agg(F.min_by(_hit_b(), order).alias("taken"))


def _waves() -> Column:
    return F.col("name").startswith(WAVE)


@stage(_waves, _rivals)
def promote_long(finals: DataFrame, hits: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Waves in conflict with a stronger long symbol hand their place over."""
    waves = finals.where(_waves())
    return take_over(waves, _local_long(waves, hits, "place"), "long_promoted", LONG_RESCUE)


def _weak_waves() -> Column:
    return F.col("name").startswith(WAVE) & (F.col("source") != TEXT) & (F.col("match") >= 50) & (F.col("coverage") >= 70) & (F.col("purity") >= 50) & (F.col("context") <= 35)


@stage(None, _rivals, _weak_waves)
def gain_long(finals: DataFrame, hits: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Long symbols that win against waves which aren't final open places of their own: best wave first, not near a long symbol
    that is there by then, four a plan. (Two waves that hand over to one long symbol are both near it, so it comes once.)"""
    waves = hits.where(_weak_waves())
    found = _local_long(waves, hits, "id").where("taken.match >= 62 and taken.coverage >= 68 and taken.purity >= 72")
    near = lambda a, b: shares(a, b, 25) | within(a, b, 4600)
    there = finals.where(F.col("name").isin(*LONG)).select("plan_id", "place", "x", "y", "w", "h")
    free = waves.join(meet(waves, there, near, 46).select(F.col("id_a").alias("id")).distinct(), "id", "left_anti").join(found, "id")
    free = cut(free.select("plan_id", "id", "x", "y", "w", "h", F.struct(*(-F.col(c) for c in ("match", "coverage", "purity")), "id").alias("rank"), "taken"))
    winners = free.select("plan_id", F.col("id").alias("first"), F.col("rank").alias("before"), *(F.col(f"taken.{c}").alias(c) for c in "xywh"))
    blocks = meet(winners, free.select("plan_id", "id", "rank", "x", "y", "w", "h"), near, 46).where(F.col("before_a") < F.col("rank_b")).select(F.col("first_a").alias("first"), F.col("id_b").alias("id")).distinct()
    kept = free.join(selection.ordered_scan(free, blocks, F.count("*") > 0), "id", "left_semi")
    first = kept.withColumn("turn", F.row_number().over(Window.partitionBy("plan_id").orderBy("rank"))).where(F.col("turn") <= MOST_GAINED)
    return gained(first.select("plan_id", "taken.*"), "long_gained", LONG_RESCUE)


@stage(_waves, _rivals)
def drop_waves(finals: DataFrame, hits: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """Waves near a long symbol, final or not, that matches better go."""
    waves, fit = finals.where(_waves()), _rivals() & (F.col("match") >= 56)
    some = ["plan_id", "x", "y", "w", "h", "match"]
    pool = hits.where(fit).select(*some).unionByName(finals.where(fit).select(*some)).distinct()
    beats = lambda a, b: (shares(a, b, 8) | within(a, b, 8600)) & (F.col("match_b") >= F.greatest(F.lit(56), F.col("match_a") + 4))
    return without(waves, meet(waves, pool, beats, 86))


def _labelled(boxes: DataFrame, key: str, words: DataFrame, wide: tuple[float, float], high: tuple[float, float], says: Column) -> DataFrame:
    """(key_a): boxes with a word that ``says`` so, whose centre lies in the box widened by a least number of pixels or a share of its size."""
    pad_x, pad_y = (F.bround(F.greatest(F.lit(least), F.col(size) * share)).cast("long") for size, (least, share) in (("w", wide), ("h", high)))
    boxes = boxes.withColumns({"px": pad_x, "py": pad_y})

    def inside(a: Box, b: Box) -> Column:
        room = Box(columns=(a.x - F.col("px_a"), a.y - F.col("py_a"), a.w + 2 * F.col("px_a"), a.h + 2 * F.col("py_a")))
        return G.center_within(b, room) & says

    return meet(boxes, words, inside, F.greatest("px", "py")).select(f"{key}_a").distinct()


def _named() -> Column:
    return F.col("name").rlike(LABELLED)


@stage(_named)
def relabel_floor_boxes(finals: DataFrame, hits: DataFrame, words: DataFrame, floor_box: tuple[int, str, int]) -> DataFrame:
    """Labelled symbols become the floor box (its number, name and hue) where a word next to them says so."""
    mine = finals.where(_named())
    named = _labelled(mine, "place", words, (70.0, 0.75), (34.0, 0.55), F.col("token_b").rlike("^PEL.*PP$"))
    number, name, hue = floor_box
    new = {"template_id": F.lit(number).cast("long"), "name": F.lit(name), "hue": F.lit(hue).cast("long"), "source": F.lit(RELABEL), "stage": F.lit("floor_boxes_relabelled")}
    out = mine.join(named.select(F.col("place_a").alias("place"), F.lit(True).alias("named")), "place", "left")
    return out.select("plan_id", *((F.when(F.col("named"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c)) for c in (*HIT, "place", "stage")))


def _strong_labelled() -> Column:
    return (F.col("source") != TEXT) & _named() & (F.col("match") >= 56) & (F.col("verif") >= 70) & (F.col("coverage") >= 55) & (F.col("purity") >= 88)


@stage(None, _strong_labelled)
def rescue_labelled(finals: DataFrame, hits: DataFrame, words: DataFrame) -> DataFrame:
    """Strong symbols with their own label next to them come back where no final hit of their kind is, best first."""
    fit = hits.where(_strong_labelled())
    own = F.col("token_b") == F.regexp_extract(F.col("name_a"), r"^\d+_(.*)$", 1)
    fit = fit.join(_labelled(fit, "id", words, (48.0, 0.70), (42.0, 0.72), own).withColumnRenamed("id_a", "id"), "id", "left_semi")
    same = lambda a, b: within(a, b, F.greatest(F.lit(2000), F.least(a.w, a.h, b.w, b.h) * 55))
    return gained(_best_apart(fit, finals.where(F.col("source") != TEXT), same, 20), "labelled_rescued")


def _long_labels() -> Column:
    return (F.col("source") == TEXT) & F.col("name").rlike(r"^\d+_L\d+$")


def _rescued_long() -> Column:
    return (F.col("source") == LONG_RESCUE) & F.col("name").isin(*LONG)


@stage(_rescued_long, _long_labels)
def drop_rescued_long(finals: DataFrame, hits: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """On plans with true waves, rescued long symbols go that are thin strokes without a label near, that stand by two waves, or
    that stand by one and are weak."""
    waves = finals.where(F.col("name").startswith(WAVE) & (F.col("source") != TEXT) & (F.col("match") >= 50) & (F.col("verif") >= 50) & (F.col("coverage") >= 75) & (F.col("purity") >= 52))
    mine = finals.where(_rescued_long())
    rescued = mine.join(waves.select("plan_id").distinct(), "plan_id", "left_semi")

    def related(a: Box, b: Box) -> Column:
        common = F.greatest(F.lit(0), F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x))
        gap = F.greatest(F.lit(0), F.greatest(a.x, b.x) - F.least(a.x + a.w, b.x + b.w))
        (ax, ay), (bx, by) = a.center2, b.center2
        beside = (common * 100 >= F.least(F.greatest(F.lit(800), b.w * 25), F.greatest(F.lit(800), a.w * 18))) | (gap * 100 <= F.greatest(F.lit(1200), F.least(a.w, b.w) * 22))
        beside = beside | (F.abs(ax - bx) * 50 <= F.greatest(F.lit(4800), a.w * 55))
        level = F.abs(ay - by) * 50 <= F.greatest(F.lit(3400), (a.h + b.h) * 75)
        return ((G.intersection(a, b) > 0) & (shares(a, b, 16) | (within(a, b, 9200) & shares(a, b, 6)))) | (beside & level)

    by = meet(rescued, waves, related, F.greatest(F.lit(48), F.col("w"), F.col("h")), F.greatest("w", "h"))
    by = by.groupBy(F.col("place_a").alias("place")).agg(F.count("*").alias("waves"))
    labels = hits.where(_long_labels())

    def near(a: Box, b: Box) -> Column:
        px, py = (F.bround(F.greatest(F.lit(v), side * share)).cast("long") for v, side, share in ((72.0, a.w, 0.45), (64.0, a.h, 1.60)))
        room = Box(columns=(a.x - px, a.y - py, a.w + 2 * px, a.h + 2 * py))
        close = F.col("hue_b").isNull() | (G.hue_distance(F.col("hue_a"), F.col("hue_b")) <= 18)
        return close & (G.center_within(b, room) | shares(a, b, 4) & (G.intersection(a, b) > 0) | within(a, b, F.greatest(F.lit(9600), a.w * 85)))

    told = meet(rescued.where(F.col("hue").isNotNull()), labels, near, F.greatest(F.lit(96), F.col("w"), F.col("h") * 2)).select(F.col("place_a").alias("place")).distinct()
    state = rescued.join(by, "place", "left").join(told.withColumn("told", F.lit(True)), "place", "left")
    thin = (F.col("content") <= 5) & (F.col("w") * 100 >= F.col("h") * 245) & (F.col("visual_h") <= F.greatest(F.lit(22), F.bround(F.col("h") * 0.55).cast("long"))) & F.col("told").isNull()
    weak = (F.col("waves") >= 1) & ((F.col("context") <= 34) | (F.col("verif") <= 62))
    gone = state.where(thin | F.coalesce((F.col("waves") >= 2) | weak, F.lit(False)))
    return without(mine, gone.withColumnRenamed("place", "place_a"))


def _weak_short() -> Column:
    return F.col("name").isin(*SHORT) & (F.col("source") != RELABEL) & (F.col("match") < 70) & (F.col("context") < 50)


@stage(_weak_short)
def drop_short(finals: DataFrame, hits: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """Weak short symbols near a fuller one of another kind go."""
    weak = finals.where(_weak_short())
    fuller = lambda a, b: within(a, b, 8500) & ((F.col("verif_b") >= F.col("verif_a") + 8) | (F.col("context_b") >= 65))
    # almost all final hits are on the other side, so cells are large and few of these lie in several
    return without(weak, meet(weak, finals.where(~F.col("name").isin(*SHORT) & (F.col("source") != TEXT)), fuller, 85, cell=512))


def _sparse() -> Column:
    broad = (F.col("w") * F.col("h") >= 4500) & (F.greatest("w", "h") * 100 <= F.greatest(F.lit(1), F.least("w", "h")) * 175)
    return F.coalesce(F.upper("name").contains(PANEL) & broad & (F.col("coverage") < 50) & (F.col("match") < 50) & (F.col("verif") < 62), F.lit(True))


@stage(_sparse)
def drop_sparse_panels(finals: DataFrame, hits: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """Broad panels with little of their colour go: they bridge two small symbols."""
    return finals.where(F.lit(False))


@stage(lambda: F.lit(True))
def one_of_each(finals: DataFrame, hits: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """The best of final hits with the same symbol and box."""
    order = Window.partitionBy("plan_id", "template_id", *"xywh").orderBy(*(-F.col(c) for c in ("verif", "match", "coverage", "purity", "context")), "place")
    return finals.withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")


def stages(floor_box: tuple[int, str, int]) -> list[tuple[str, Stage]]:
    relabel = stage(_named)(lambda f, h, w: relabel_floor_boxes.part(f, h, w, floor_box))
    return [
        ("family_reclassed", reclass_family), ("waves_rescued", rescue_waves), ("long_promoted", promote_long), ("long_gained", gain_long), ("waves_dropped", drop_waves),
        ("floor_boxes_relabelled", relabel), ("labelled_rescued", rescue_labelled), ("rescued_long_dropped", drop_rescued_long),
        ("short_dropped", drop_short), ("sparse_panels_dropped", drop_sparse_panels), ("repeats_dropped", one_of_each),
    ]


def resolve(finals: DataFrame, hits: DataFrame, words: DataFrame, chain: list[tuple[str, Stage]]) -> tuple[DataFrame, DataFrame]:
    """The final hits after all stages, and (plan_id, stage, turn, changed, left): how many rows each stage added or changed, and left.

    Final hits are kept as tables that are written once: the first ones, and what each stage made. A row says ``until`` which stage it
    stays, the first one that may change or drop it, so a stage writes what there is in place of its own rows and neither writes nor
    shuffles others. Of the other hits, only those that some stage reads are written. The last stage is left to who reads the result.
    """
    steps = [step if hasattr(step, "part") else stage(lambda: F.lit(True), lambda: F.lit(True))(step) for _, step in chain]
    read = reduce(Column.__or__, (condition() for condition in dict.fromkeys(c for step in steps for c in step.reads)), F.lit(False))
    hits, words, columns, last = stored(hits.where(read)), stored(words), finals.columns, len(steps)

    def lasting(rows: DataFrame, turn: int) -> DataFrame:
        until = F.lit(last)
        for k in reversed(range(turn, last)):
            until = F.when(steps[k].mine(), F.lit(k)).otherwise(until)
        return rows.select(*columns, until.alias("until"))

    def there(turn: int) -> DataFrame:
        return reduce(DataFrame.unionByName, (t.where(F.col("until") >= turn) for t in tables)).select(*columns)

    tables = [stored(lasting(finals, 0))]
    for turn, step in enumerate(steps, 1):
        new = lasting(step.part(there(turn - 1), hits, words), turn)
        tables.append(new if turn == last else stored(new))
    return there(last), _counted(tables, [name for name, _ in chain])


def _counted(tables: list[DataFrame], names: list[str]) -> DataFrame:
    """How many rows of each plan are there after each stage: the table at place k is from stage k - 1, and the first one was there before."""
    rows = reduce(DataFrame.unionByName, (t.select("plan_id", F.col("stage").alias("by"), F.lit(max(k - 1, 0)).alias("since"), "until") for k, t in enumerate(tables)))
    spans = rows.where("since < until").groupBy("plan_id", "by", "since", "until").agg(F.count("*").alias("n"))
    turns = spans.select("*", F.explode(F.sequence("since", F.col("until") - 1)).alias("turn"))
    named = turns.withColumn("stage", F.element_at(F.array(*map(F.lit, names)), F.col("turn") + 1))
    counts = named.groupBy("plan_id", "stage", "turn").agg(F.coalesce(F.sum(F.when(F.col("by") == F.col("stage"), F.col("n"))), F.lit(0)).alias("changed"), F.sum("n").alias("left"))
    return counts.select("plan_id", "stage", "turn", "changed", "left")
