"""A template's mask laid over a plan at every displacement near a hit: crops of plans in 64-bit words, and what fits best."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyplan.operators import tiles as T
from tallyplan.operators.lineage import cut
from tallyplan.operators.variants import Variant

# Fixed values, shares in percent.
CONTEXT_MARGIN = 40
CHILD_COVERAGE, CROP_PURITY = 62, 90


class Promotion(NamedTuple):
    """How a hit of a child's variant may become one of a fuller parent's: the child's place in the parent, and the parent's
    pixels that the child doesn't have, of which ``extra`` percent must be on the plan; ``grown`` if the plan's ink counts
    widened by a pixel. Shares in percent, ``drop`` of the hit's verification that may be lost."""

    child: tuple[int, int, int, bool]
    parent: Variant
    x: int
    y: int
    extension: np.ndarray
    extra: int
    radius: int
    grown: bool = False
    least_purity: int = 58
    least_context: int = 22
    least_verification: int = 62
    drop: int = 6


def crops(pieces: DataFrame, boxes: DataFrame, pad: int, side: int = 128) -> DataFrame:
    """``boxes(id, plan_id, x, y, w, h, ...)`` with the plan around each, ``pad`` pixels wider on all sides, as ``bits``, and
    the plan's ``rows`` and ``columns`` (null where no ink is near).

    A box meets the tiles that it overlaps by an equality join, and gathers no more tiles than its own size makes.
    """
    over = lambda at, size: F.explode(F.sequence(F.floor((F.col(at) - pad) / side), F.floor((F.col(at) + F.col(size) + pad - 1) / side)))
    spread = boxes.select("id", "plan_id", *"xywh").withColumn("tile_r", over("y", "h")).withColumn("tile_c", over("x", "w"))
    drawn = T.tiles(pieces, side).select("plan_id", F.floor(F.col("r") / side).alias("tile_r"), F.floor(F.col("c") / side).alias("tile_c"), F.struct("r", "c", F.col("h").alias("th"), F.col("w").alias("tw"), "bits", "rows", "columns").alias("tile"))
    met = spread.join(drawn, ["plan_id", "tile_r", "tile_c"]).groupBy("id").agg(F.collect_list("tile").alias("parts"))
    found = boxes.join(met, "id", "left")
    kept = boxes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.portions(batches):
            out, sizes = [], []
            for x, y, w, h, parts in zip(*(batch.column(c).to_pylist() for c in (*"xywh", "parts")), strict=True):
                sizes.append((parts[0]["rows"], parts[0]["columns"]) if parts else (None, None))
                mask = np.zeros((h + 2 * pad, w + 2 * pad), dtype=bool)
                for part in parts or []:
                    a, b = max(part["r"], y - pad), min(part["r"] + part["th"], y + h + pad)
                    p, q = max(part["c"], x - pad), min(part["c"] + part["tw"], x + w + pad)
                    if a < b and p < q:
                        piece = T.unpacked(part["bits"], part["th"], part["tw"])
                        mask[a - y + pad : b - y + pad, p - x + pad : q - x + pad] = piece[a - part["r"] : b - part["r"], p - part["c"] : q - part["c"]]
                out.append(T.packed(mask))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.binary()), *(pa.array([n[k] for n in sizes], pa.int32()) for k in (0, 1))], [*kept, "bits", "rows", "columns"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.schema) + ", bits binary, rows int, columns int"
    return found.select(*kept, "parts").mapInArrow(run, kind)


def words(mask: np.ndarray) -> np.ndarray:
    """Rows of a mask as 64-bit words, the first column in the lowest bit; a row may have many words."""
    h, w = mask.shape
    wide = np.zeros((h, -(-w // 64) * 64), dtype=bool)
    wide[:, :w] = mask
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def shifted(rows: np.ndarray, by: int, width: int) -> np.ndarray:
    """The ``width`` columns of rows of words that begin ``by`` columns in."""
    first, bit = divmod(by, 64)
    n = -(-width // 64)
    wide = np.concatenate([rows[:, first:], np.zeros((len(rows), n + 1), np.uint64)], axis=1)
    out = wide[:, :n] >> np.uint64(bit)
    if bit:
        out |= wide[:, 1 : n + 1] << np.uint64(64 - bit)
    left = width - 64 * (n - 1)
    if left < 64:
        out[:, -1] &= np.uint64((1 << left) - 1)
    return out


def counts_at(plan: np.ndarray, *templates: np.ndarray, at_once: int = 16) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(first column, counts of common ink with each template, the plan's ink under them), the counts as (column, row) of the
    displacement, for all displacements of templates of one size over a plan, so many columns at a time: rows of words are
    shifted once per column, and bits counted word by word."""
    h, w = templates[0].shape
    rows = words(plan)
    laid = [words(t) for t in templates]
    for first in range(0, plan.shape[1] - w + 1, at_once):
        under = np.stack([shifted(rows, c, w) for c in range(first, min(first + at_once, plan.shape[1] - w + 1))])
        views = np.lib.stride_tricks.sliding_window_view(under, h, axis=1)  # (column, displacement, word, row)
        yield first, [np.bitwise_count(views & t.T).sum(axis=(2, 3), dtype=np.int64) for t in laid], np.bitwise_count(views).sum(axis=(2, 3), dtype=np.int64)


def common_at(plan: np.ndarray, *templates: np.ndarray) -> Iterator[tuple[int, int, tuple[int, ...], int]]:
    """(row, column, counts of common ink with each template, the plan's ink under them) at every displacement."""
    for first, counts, ink in counts_at(plan, *templates):
        for c, r in np.ndindex(*ink.shape):
            yield r, first + c, tuple(int(n[c, r]) for n in counts), int(ink[c, r])


def context_margin(h: int, w: int) -> int:
    return max(3, int(round(max(h, w) * CONTEXT_MARGIN / 100)))


def rules(children: list[Variant], parents: list[Variant], extra: int, radius: int, child_coverage: int = CHILD_COVERAGE, crop_purity: int = CROP_PURITY, any_turn: bool = True, **bounds) -> list[Promotion]:
    """Promotions between two templates' variants: the child lies where it correlates best with the parent, if the parent has
    its pixels there and no others."""
    out = []
    for child in children:
        for parent in parents:
            if (not any_turn and parent.turn != child.turn) or child.mask.shape[0] > parent.mask.shape[0] or child.mask.shape[1] > parent.mask.shape[1]:
                continue
            h, w = child.mask.shape
            common = T.Correlator(parent.mask).common(child.mask)
            ink = T.window_sums(parent.mask, h, w)
            match = common / np.sqrt(np.maximum(ink, 1) * child.mask.sum())
            y, x = divmod(int(match.argmax()), match.shape[1])
            both, below = int(common[y, x]), int(ink[y, x])
            if both * 100 < child_coverage * int(child.mask.sum()) or both * 100 < crop_purity * below:
                continue
            extension = parent.mask.copy()
            extension[y : y + h, x : x + w] &= ~child.mask
            if extension.any():
                out.append(Promotion(child.key, parent, x, y, extension, extra, radius, **bounds))
    return out


class Fit(NamedTuple):
    x: int
    y: int
    extra: float
    match: float
    coverage: float
    purity: float
    context: float
    verification: float


def best_fit(plan: np.ndarray, x0: int, y0: int, x: int, y: int, rule: Promotion, verification: float, size: tuple[int, int]) -> Fit | None:
    """Where the parent fits best within the rule's radius of (x, y), of all places that pass the rule: the most of the extra
    pixels, then verification, match, and the first place row by row. ``plan`` begins at (x0, y0) of one of
    ``size`` (rows, columns)."""
    mask, r = rule.parent.mask, rule.radius
    h, w = mask.shape
    view = plan
    if rule.grown:  # no ink grows beyond the plan's edges
        view = T.dilated(plan, 1)
        view[: max(0, -y0)], view[max(0, size[0] - y0) :] = False, False
        view[:, : max(0, -x0)], view[:, max(0, size[1] - x0) :] = False, False
    top, left = y - r - y0, x - r - x0
    near = view[top : top + h + 2 * r, left : left + w + 2 * r]
    margin, t, e = context_margin(h, w), int(mask.sum()), int(rule.extension.sum())
    good = []
    for first, (both, more), ink in counts_at(near, mask, rule.extension):
        for c, dr in np.argwhere((more * 100 >= rule.extra * e) & (ink > 0)).tolist():
            good.append((dr, first + c, int(both[c, dr]), int(more[c, dr]), int(ink[c, dr])))
    if not good:
        return None
    sums = np.zeros((view.shape[0] + 1, view.shape[1] + 1), dtype=np.int64)
    sums[1:, 1:] = view.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    best, best_key = None, None
    for dr, dc, both, more, ink in good:
        a, b = max(0, top + dr - margin), min(view.shape[0], top + dr + h + margin)
        p, q = max(0, left + dc - margin), min(view.shape[1], left + dc + w + margin)
        context = int(sums[b, q] - sums[a, q] - sums[b, p] + sums[a, p])
        match, coverage, purity, explained = both / (ink * t) ** 0.5, both / t, both / ink, both / context
        score = 0.45 * match + 0.20 * coverage + 0.15 * purity + 0.20 * explained
        if purity * 100 < rule.least_purity or explained * 100 < rule.least_context or score * 100 < rule.least_verification or score * 100 < verification * 100 - rule.drop:
            continue
        key = (more / e, round(score, 9), round(match, 9), -dr, -dc)
        if best_key is None or key > best_key:
            best, best_key = Fit(x0 + left + dc, y0 + top + dr, more / e, match, coverage, purity, explained, score), key
    return best


def promote(pieces: DataFrame, hits: DataFrame, promotions: list[Promotion]) -> DataFrame:
    """Hits with the promotions that apply: a hit of a child becomes the parent's where enough of the parent's extra pixels are
    on the plan near it and the parent verifies; others stay as they are.

    ``hits(id, plan_id, template_id, scale, turn, mirrored, x, y, w, h, verification)``; out come the same columns with
    promoted_from (null if it stays), extra, coverage, purity and context of the new mask.
    """
    hits = cut(hits) if promotions else hits  # they are read three times, and finding them is most of the work
    by_child: dict[tuple, list[Promotion]] = {}
    for rule in promotions:
        by_child.setdefault(rule.child, []).append(rule)
    reach = max((r.radius + context_margin(*r.parent.mask.shape) + max(r.parent.mask.shape) for r in promotions), default=0) + 2
    names = ["id", "plan_id", "template_id", "scale", "turn", "mirrored", "x", "y", "w", "h", "verification"]
    extra = ["promoted_from", "extra", "coverage", "purity", "context"]
    keys = hits.sparkSession.createDataFrame([k for k in by_child], "template_id long, scale int, turn int, mirrored boolean") if by_child else None
    stay = hits.select(*names) if keys is None else hits.select(*names).join(F.broadcast(keys), ["template_id", "scale", "turn", "mirrored"], "left_anti").select(*names)
    stay = stay.select(*names, F.lit(None).cast("long").alias("promoted_from"), *(F.lit(None).cast("double").alias(c) for c in extra[1:]))
    if keys is None:
        return stay
    children = hits.select(*names).join(F.broadcast(keys), ["template_id", "scale", "turn", "mirrored"], "left_semi").select(*names)
    bounds = {f.name: f.dataType.simpleString() for f in children.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.portions(batches):
            out = []
            for row in batch.to_pylist():
                plan = T.unpacked(row["bits"], row["h"] + 2 * reach, row["w"] + 2 * reach)
                fits = []
                for k, rule in enumerate([] if row["rows"] is None else by_child[row["template_id"], row["scale"], row["turn"], row["mirrored"]]):
                    fit = best_fit(plan, row["x"] - reach, row["y"] - reach, row["x"] - rule.x, row["y"] - rule.y, rule, row["verification"], (row["rows"], row["columns"]))
                    if fit:
                        fits.append(((fit.extra, round(fit.verification, 9), round(fit.match, 9), -k), fit, rule))
                row |= dict.fromkeys(extra)
                if fits:
                    _, fit, rule = max(fits, key=lambda f: f[0])
                    parent = rule.parent
                    row |= {"promoted_from": row["template_id"], "template_id": parent.template_id, "scale": parent.scale, "turn": parent.turn, "mirrored": parent.mirrored, "x": fit.x, "y": fit.y, "w": parent.mask.shape[1], "h": parent.mask.shape[0]}
                    row |= {"verification": fit.verification, "extra": fit.extra, "coverage": fit.coverage, "purity": fit.purity, "context": fit.context}
                out.append(row)
            kinds = {**{n: T._KINDS[{"bigint": "long"}.get(bounds[n], bounds[n])] for n in names}, "promoted_from": pa.int64(), **dict.fromkeys(extra[1:], pa.float64())}
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], kinds[n]) for n in [*names, *extra]], [*names, *extra])

    kind = ", ".join(f"{n} {bounds[n]}" for n in names) + ", promoted_from long, " + ", ".join(f"{n} double" for n in extra[1:])
    return crops(pieces, children, reach).mapInArrow(run, kind).unionByName(stay)
