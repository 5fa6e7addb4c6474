"""Plans of any size as binary masks in pieces, worked on tile by tile with a halo.

A raster is a table of pieces ``(plan_id, rows, columns, r, c, h, w, bits)``: a plan of rows x columns pixels has ink where any of
its pieces has; ``bits`` are the piece's h x w pixels, row by row, packed into bytes. Pieces may have any size and may overlap.
Nothing gathers a plan: pieces are cut at the windows of the tiles that they meet, and a task assembles one window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyplan.operators.graph import connected_components

SIDE = 256
PIECES = "plan_id long, rows int, columns int, r long, c long, h int, w int, bits binary"
_FIELDS = {"plan_id": pa.int64(), "rows": pa.int32(), "columns": pa.int32(), "r": pa.int64(), "c": pa.int64(), "h": pa.int32(), "w": pa.int32(), "bits": pa.binary()}
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
#: A pixel's number is its plan, row and column in one long; plans have fewer than 2^20 rows and columns.
_ROW, _PLAN = 20, 40


class Window(NamedTuple):
    """A tile with its halo: ``mask`` begins at row r0 and column c0 of the plan; the tile's own pixels are mask[own]."""

    plan_id: int
    rows: int
    columns: int
    r0: int
    c0: int
    mask: np.ndarray
    own: tuple[slice, slice]


def packed(mask: np.ndarray) -> bytes:
    return np.packbits(mask.astype(bool).ravel()).tobytes()


def unpacked(bits: bytes, h: int, w: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=h * w).reshape(h, w).astype(bool)


def pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of pieces whose last field is still a mask."""
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
    masks = columns[5]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, kind) for c, kind in zip(columns[:5], list(_FIELDS.values())[:5], strict=True)), pa.array([m.shape[0] for m in masks], pa.int32()), pa.array([m.shape[1] for m in masks], pa.int32()), pa.array([packed(m) for m in masks], pa.binary())],
        list(_FIELDS),
    )


#: So many rows are turned into masks at a time, whatever batches Spark hands over.
AT_ONCE = 128


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches as smaller ones, so that a task holds the pixels of few rows; one empty batch stays one."""
    for batch in batches:
        for start in range(0, max(1, batch.num_rows), AT_ONCE):
            yield batch.slice(start, AT_ONCE)


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    yield from zip(*(batch.column(name).to_pylist() for name in _FIELDS), strict=True)


def _cut(side: int, before: int, after: int):
    """Cuts pieces at the windows that they meet; what has no ink is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            out, tiles = [], []
            for plan, rows, columns, r, c, h, w, bits in _rows_of(batch):
                mask = unpacked(bits, h, w)
                for tr in range(max(0, (r - after) // side), min((rows - 1) // side, (r + h - 1 + before) // side) + 1):
                    a, b = max(r, tr * side - before), min(r + h, (tr + 1) * side + after, rows)
                    for tc in range(max(0, (c - after) // side), min((columns - 1) // side, (c + w - 1 + before) // side) + 1):
                        p, q = max(c, tc * side - before), min(c + w, (tc + 1) * side + after, columns)
                        part = mask[a - r : b - r, p - c : q - c]
                        if part.any():
                            out.append((plan, rows, columns, a, p, part))
                            tiles.append((tr, tc))
            cut = pieces_batch(out)
            tr, tc = zip(*tiles, strict=True) if tiles else ((), ())
            yield pa.RecordBatch.from_arrays([*cut.columns, pa.array(tr, pa.int32()), pa.array(tc, pa.int32())], [*cut.schema.names, "tile_r", "tile_c"])

    return run


def tilewise(pieces: DataFrame, schema: str, compute: Callable[[Window], tuple[list | np.ndarray, ...]], side: int = SIDE, before: int = 0, after: int = 0) -> DataFrame:
    """Rows that ``compute`` makes of each tile's window, ``before`` pixels wider above and to the left and ``after`` below and to
    the right; it returns the columns of ``schema``. Tiles whose window has no ink aren't looked at."""
    kinds = [_KINDS[f.split()[1]] for f in schema.split(",")]
    names = [f.split()[0] for f in schema.split(",")]

    def run(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        r0, c0 = first["tile_r"] * side - before, first["tile_c"] * side - before
        mask = np.zeros((side + before + after,) * 2, dtype=bool)
        for r, c, h, w, bits in zip(*(table.column(n).to_pylist() for n in ("r", "c", "h", "w", "bits")), strict=True):
            mask[r - r0 : r - r0 + h, c - c0 : c - c0 + w] |= unpacked(bits, h, w)
        own = slice(before, before + side)
        columns = compute(Window(first["plan_id"], first["rows"], first["columns"], r0, c0, mask, (own, own)))
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    cut = pieces.mapInArrow(_cut(side, before, after), PIECES + ", tile_r int, tile_c int")
    return cut.groupBy("plan_id", "tile_r", "tile_c").applyInArrow(run, schema)


def tiles(pieces: DataFrame, side: int = SIDE) -> DataFrame:
    """The same raster with one piece a tile, of the tile's size."""

    def compute(w: Window) -> tuple[list, ...]:
        part = w.mask[: w.rows - w.r0, : w.columns - w.c0]
        return [w.plan_id], [w.rows], [w.columns], [w.r0], [w.c0], [part.shape[0]], [part.shape[1]], [packed(part)]

    return tilewise(pieces, PIECES, compute, side)


def transposed(pieces: DataFrame) -> DataFrame:
    """The raster with rows and columns exchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            yield pieces_batch([(plan, columns, rows, c, r, unpacked(bits, h, w).T) for plan, rows, columns, r, c, h, w, bits in _rows_of(batch)])

    return pieces.mapInArrow(run, PIECES)


# --- correlation


def window_sums(mask: np.ndarray, h: int, w: int) -> np.ndarray:
    """Ink in every window of h x w, from a summed-area table."""
    table = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1), dtype=np.int64)
    table[1:, 1:] = mask.cumsum(axis=0, dtype=np.int64).cumsum(axis=1)
    return table[h:, w:] - table[:-h, w:] - table[h:, :-w] + table[:-h, :-w]


class Correlator:
    """Counts of common ink of one mask with many templates at every place, by products of transforms; exact, since rounded.
    Masks are widened to a size of small factors. ``known`` keeps the templates' transforms for further masks of the size."""

    def __init__(self, mask: np.ndarray, known: dict[tuple, np.ndarray] | None = None) -> None:
        self.mask, self.shape, self.known = mask, mask.shape, {} if known is None else known
        self.wide = tuple(-(-n // 32) * 32 for n in mask.shape)
        self.transform = np.fft.rfft2(mask.astype(np.float64), self.wide)

    def common(self, template: np.ndarray) -> np.ndarray:
        h, w = template.shape
        key = (self.wide, template.shape, template.tobytes())
        if key not in self.known:
            self.known[key] = np.conj(np.fft.rfft2(template.astype(np.float64), self.wide))
        out = np.fft.irfft2(self.transform * self.known[key], self.wide)
        return np.rint(out[: self.shape[0] - h + 1, : self.shape[1] - w + 1]).astype(np.int64)


def scores(common: np.ndarray, ink: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Correlation of centred pixels from counts; 0 where either side is all ink or none."""
    n, t = template.size, int(template.sum())
    below = (n * ink - ink * ink) * (n * t - t * t)
    return np.where(below > 0, (n * common - ink * t) / np.sqrt(np.where(below > 0, below, 1).astype(np.float64)), 0.0)


def peak_radius(size: int, share: float = 0.25) -> int:
    """How far a peak must be the highest: half of an odd number of pixels, a quarter of the template's size, 3 at least."""
    k = max(3, int(size * share))
    return (k if k % 2 else k + 1) // 2


def around(values: np.ndarray, up: int, across: int) -> np.ndarray:
    """The highest value within so many rows and columns of each place."""
    for axis, reach in ((0, up), (1, across)):
        wide = np.pad(values, [(reach, reach) if k == axis else (0, 0) for k in (0, 1)], constant_values=-np.inf)
        values = np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1, axis=axis).max(axis=-1)
    return values


def template_peaks(pieces: DataFrame, variants: list[tuple[int, int, np.ndarray]], threshold: float, side: int = SIDE) -> DataFrame:
    """Places where a variant ``(template_id, turn, mask)`` correlates by ``threshold`` (above 0) or more and best around:
    (plan_id, template_id, turn, x, y, w, h, common, score).

    A place belongs to the tile of its upper left corner, which alone reports it; the halo is as wide as the largest variant and
    the neighbourhood of a peak, so that the result doesn't depend on the tiles. Variants are a request's few templates.
    """
    if not variants:
        raise ValueError("no template to look for")
    reach = max(max(peak_radius(m.shape[0]), peak_radius(m.shape[1])) for _, _, m in variants)
    largest = max(max(m.shape) for _, _, m in variants)
    masks = [(t, turn, m.astype(bool)) for t, turn, m in variants]
    known: dict[tuple, np.ndarray] = {}

    def compute(w: Window) -> tuple[list, ...]:
        out: list[tuple] = []
        ink = {shape: window_sums(w.mask, *shape) for shape in {m.shape for _, _, m in masks}}
        view, rows, columns = Correlator(w.mask, known), np.arange(w.mask.shape[0]) + w.r0, np.arange(w.mask.shape[1]) + w.c0
        for template_id, turn, mask in masks:
            h, wide = mask.shape
            common = view.common(mask)
            value = scores(common, ink[h, wide], mask)
            r, c = rows[: value.shape[0]], columns[: value.shape[1]]
            on_plan = ((r >= 0) & (r + h <= w.rows))[:, None] & ((c >= 0) & (c + wide <= w.columns))[None, :]
            value = np.where(on_plan, value, -np.inf)
            own = np.zeros_like(on_plan)
            own[w.own] = True
            if not (value[own] >= threshold).any():
                continue
            up, across = peak_radius(h), peak_radius(wide)
            for i, j in np.argwhere((value >= threshold) & own).tolist():  # few places come that far
                if value[i, j] < value[max(0, i - up) : i + up + 1, max(0, j - across) : j + across + 1].max() - 1e-6:
                    continue
                out.append((w.plan_id, template_id, turn, int(c[j]), int(r[i]), wide, h, int(common[i, j]), float(value[i, j])))
        return tuple(zip(*out, strict=True)) if out else tuple([] for _ in range(9))

    return tilewise(pieces, "plan_id long, template_id long, turn int, x long, y long, w int, h int, common long, score double", compute, side, reach, reach + largest - 1)


# --- components


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, column after the last) of the runs of ink, in reading order."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edge == 1)
    return rows, starts, np.nonzero(edge == -1)[1]


def _united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's set, after uniting a with b."""
    parent = np.arange(n)
    while len(a):
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        differ = low != high
        a, b = a[differ], b[differ]
        np.minimum.at(parent, high[differ], low[differ])
        while (parent[parent] != parent).any():
            parent = parent[parent]
    return parent


def run_components(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (row, start, end) and the first run of each one's component, over eight neighbours."""
    rows, starts, ends = _runs(mask)
    wide = mask.shape[1] + 2
    low = np.searchsorted(rows * wide + ends, (rows + 1) * wide + starts, side="left")
    high = np.searchsorted(rows * wide + starts, (rows + 1) * wide + ends, side="right")
    many = np.maximum(high - low, 0)
    upper = np.repeat(np.arange(len(rows)), many)
    lower = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    return rows, starts, ends, _united(len(rows), upper, lower)


def dilated(mask: np.ndarray, reach: int) -> np.ndarray:
    """Ink within so many rows and columns."""
    return around(mask.astype(np.float32), reach, reach) > 0 if reach else mask


def pixel_number(plan_id: int, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (np.int64(plan_id) << _PLAN) | (r.astype(np.int64) << _ROW) | c.astype(np.int64)


def components(pieces: DataFrame, dilate: int = 0, side: int = SIDE) -> DataFrame:
    """Connected components of ink over eight neighbours, of the mask grown by ``dilate`` pixels:
    (plan_id, rows, columns, component, pixels, x, y, w, h, sum_x, sum_y).

    A tile unites its own runs; pixels of its last row and column, and those of its first ones with the three places that they
    touch, meet across the borders as edges between the tiles' components. Only these and sums that add up leave the tiles. A
    component is numbered by its first pixel in reading order.
    """
    kind = "plan_id long, rows int, columns int, component long, pixels long, x long, y long, right long, bottom long, sum_x long, sum_y long, beyond long, down long, line long, place long"

    def compute(w: Window) -> tuple[list, ...]:
        mask = dilated(w.mask, dilate)
        mask[max(0, w.rows - w.r0) :] = False
        mask[:, max(0, w.columns - w.c0) :] = False
        mask = mask[w.own]
        r0, c0 = w.r0 + dilate, w.c0 + dilate
        rows, starts, ends, root = run_components(mask)
        name = pixel_number(w.plan_id, rows[root] + r0, starts[root] + c0)
        firsts, of = np.unique(name, return_inverse=True)
        size = ends - starts
        total = lambda v: np.bincount(of, v, len(firsts)).astype(np.int64)
        low, high = np.full((2, len(firsts)), 1 << 40), np.full((2, len(firsts)), -1)
        for k, (a, b) in enumerate(((starts, ends), (rows, rows + 1))):
            np.minimum.at(low[k], of, a)
            np.maximum.at(high[k], of, b)
        n = len(firsts)
        met = [np.zeros((0, 5), np.int64)]
        for down, edge, line, along, at, first, last in ((1, rows, r0, c0, starts, 0, side - 1), (0, starts, c0, r0, rows, 0, side - 1)):
            for near, here in ((0, (edge == last) if down else (ends == side)), (1, edge == first)):
                some = np.flatnonzero(here)
                each = np.repeat(some, (ends - starts)[some] if down else 1)
                place = at[each] + along + (np.arange(len(each)) - np.repeat(np.cumsum((ends - starts)[some]) - (ends - starts)[some], (ends - starts)[some]) if down else 0)
                for k in (-1, 0, 1) if near else (0,):
                    met.append(np.stack([name[each], np.full(len(each), near), np.full(len(each), down), np.full(len(each), line + (0 if near else side)), place + k], axis=1))
        met = np.concatenate(met)
        m = len(met)
        join = lambda a, b: np.concatenate([a, b])
        zero, none = np.zeros(m, np.int64), np.full(n, -1)
        constant = lambda v: np.full(n + m, v)
        return (
            constant(w.plan_id), constant(w.rows), constant(w.columns), join(firsts, met[:, 0]), join(total(size), zero), join(low[0] + c0, zero), join(low[1] + r0, zero), join(high[0] + c0, zero), join(high[1] + r0, zero),
            join(total((starts + ends - 1) * size / 2 + c0 * size), zero), join(total((rows + r0) * size), zero), join(none, met[:, 1]), join(none, met[:, 2]), join(none, met[:, 3]), join(none, met[:, 4]),
        )

    from tallyplan.operators.lineage import cut

    parts = cut(tilewise(pieces, kind, compute, side, dilate, dilate))
    border = ["plan_id", "down", "line", "place"]
    one, other = (parts.where(F.col("beyond") == k).select(*border, F.col("component").alias(c)) for k, c in ((0, "a"), (1, "b")))
    edges = one.join(other, border).select("a", "b").distinct()
    named = connected_components(edges)
    stats = parts.where("beyond < 0").join(named.withColumnRenamed("component", "whole"), F.col("component") == F.col("node"), "left")
    out = stats.groupBy("plan_id", "rows", "columns", F.coalesce("whole", "component").alias("component")).agg(
        F.sum("pixels").alias("pixels"), F.min("x").alias("x"), F.min("y").alias("y"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.sum("sum_x").alias("sum_x"), F.sum("sum_y").alias("sum_y")
    )
    return out.select("plan_id", "rows", "columns", "component", "pixels", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "sum_x", "sum_y")
