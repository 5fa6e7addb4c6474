"""Raster patches as arrays of numbers: whole batches at a time as (patch, row, column) in numpy, single sums as expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE = 8
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def patchwise(patches: DataFrame, schema: str, compute: Callable[[np.ndarray], tuple[np.ndarray, ...]], *keys: str) -> DataFrame:
    """Rows made of ``patches(vec_id, patch, keys...)`` a batch at a time.

    ``compute`` takes the patches as (n, SIDE, SIDE) and, for each further key, a column; it returns the index of each output row's
    patch and the output columns after vec_id, as ``schema`` names them. Null patches and those of other sizes give no rows.
    """
    fields = [f.strip().split() for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [k for k, v in enumerate(batch.column("patch")) if v.is_valid and len(v.as_py()) == SIDE * SIDE]
            batch = batch.take(pa.array(good, pa.int64()))
            values = np.asarray(batch.column("patch").flatten(), dtype=np.float64).reshape(-1, SIDE, SIDE)
            index, *columns = compute(values, *(np.asarray(batch.column(k)) for k in keys))
            out = [batch.column("vec_id").take(pa.array(index)), *(pa.array(c, _KINDS[k]) for c, (_, k) in zip(columns, fields[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(out, [n for n, _ in fields])

    return patches.select("vec_id", "patch", *keys).mapInArrow(run, schema)


def every(n: int, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """One output row for each patch."""
    return np.arange(n), *columns


def best_templates(patches: DataFrame, templates: list[tuple[int, list[float]]]) -> DataFrame:
    """The template that correlates best with each patch: one product of the centred patches with the centred templates."""
    ids, t = np.array([i for i, _ in templates]), np.array([v for _, v in templates], dtype=np.float64)
    t = t - t.mean(axis=1, keepdims=True)
    t /= np.maximum(np.linalg.norm(t, axis=1, keepdims=True), 1e-300)

    def compute(values: np.ndarray) -> tuple[np.ndarray, ...]:
        flat = values.reshape(len(values), -1)
        flat = flat - flat.mean(axis=1, keepdims=True)
        norm = np.linalg.norm(flat, axis=1, keepdims=True)
        scores = np.where(norm > 0, flat @ t.T / np.where(norm > 0, norm, 1), 0.0)
        best = scores.argmax(axis=1)
        return every(len(values), ids[best], scores[np.arange(len(values)), best])

    return patchwise(patches, "vec_id long, template_id long, score double", compute)


def windows(values: np.ndarray, side: int) -> np.ndarray:
    """(patch, row, column, side, side): all windows of a size."""
    return np.lib.stride_tricks.sliding_window_view(values, (side, side), axis=(1, 2))


def scan_scores(values: np.ndarray, template: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Scores of a template at every place: correlation of the centred pixels or, under a mask, of the pixels themselves."""
    w = windows(values, template.shape[0])
    if mask is None:
        t = template - template.mean()
        centred = w - w.mean(axis=(3, 4), keepdims=True)
        dot, norm = (centred * t).sum(axis=(3, 4)), np.sqrt((centred**2).sum(axis=(3, 4)) * (t**2).sum())
    else:
        dot, norm = (w * template * mask).sum(axis=(3, 4)), np.sqrt((w**2 * mask).sum(axis=(3, 4)) * (template**2 * mask).sum())
    return np.where(norm > 0, dot / np.where(norm > 0, norm, 1), 0.0)


def shifted(masks: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """Masks moved by rows and columns; what comes in is empty."""
    out = np.zeros_like(masks)
    n = masks.shape[1]
    out[:, max(0, dr) : n + min(0, dr), max(0, dc) : n + min(0, dc)] = masks[:, max(0, -dr) : n + min(0, -dr), max(0, -dc) : n + min(0, -dc)]
    return out


def dilated(masks: np.ndarray) -> np.ndarray:
    """Masks grown by one pixel in all eight directions."""
    out = np.zeros_like(masks)
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            out |= shifted(masks, dr, dc)
    return out


def eroded(masks: np.ndarray) -> np.ndarray:
    """Masks shrunk by one pixel; beyond the edge there is ink."""
    return ~dilated(~masks)


def run_lengths(masks: np.ndarray) -> np.ndarray:
    """For each pixel the length of the horizontal run of ink that it is in; 0 without ink."""
    n, rows, columns = masks.shape
    left = np.zeros((n, rows, columns), dtype=np.int64)
    for c in range(columns):
        left[:, :, c] = np.where(masks[:, :, c], (left[:, :, c - 1] if c else 0) + 1, 0)
    out = left.copy()
    for c in range(columns - 2, -1, -1):
        out[:, :, c] = np.where(masks[:, :, c] & masks[:, :, c + 1], out[:, :, c + 1], left[:, :, c])
    return out


def labels(masks: np.ndarray) -> np.ndarray:
    """The least place (row * columns + column) of each pixel's component over eight neighbours; -1 without ink."""
    n, rows, columns = masks.shape
    none = rows * columns
    label = np.where(masks, np.arange(none).reshape(1, rows, columns), none)
    while True:
        low = label.copy()
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                moved = shifted(none - label, dr, dc)  # empty comes in as none
                low = np.minimum(low, none - moved)
        low = np.where(masks, low, none)
        if (low == label).all():
            return np.where(masks, label, -1)
        label = low


def components(masks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(patch, component, pixels, row, column, rows, columns) of every component."""
    at = np.argwhere(masks)
    own = labels(masks)[masks]
    key = at[:, 0] * masks[0].size + own if len(at) else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    key, at, own = key[order], at[order], own[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([cut, [len(key)]])) if len(key) else cut
    low = [np.minimum.reduceat(at[:, k], cut) if len(cut) else cut for k in (1, 2)]
    high = [np.maximum.reduceat(at[:, k], cut) if len(cut) else cut for k in (1, 2)]
    return at[cut, 0], own[cut], size, low[0], low[1], high[0] - low[0] + 1, high[1] - low[1] + 1


def turned(values: np.ndarray, quarter: int, mirrored: bool) -> np.ndarray:
    """Patches mirrored, then turned clockwise by quarters."""
    return np.rot90(values[:, :, ::-1] if mirrored else values, -quarter, axes=(1, 2))


def nearest(values: np.ndarray, side: int) -> np.ndarray:
    """Patches at another size, each pixel the nearest one above and to the left."""
    at = np.arange(side) * values.shape[1] // side
    return values[:, at][:, :, at]


def pixels(patches: DataFrame) -> DataFrame:
    """(vec_id, r, c, v) of every pixel."""
    return patches.select("vec_id", F.posexplode("patch").alias("k", "v")).select("vec_id", F.floor(F.col("k") / SIDE).alias("r"), (F.col("k") % SIDE).cast("long").alias("c"), F.col("v").cast("double").alias("v"))


def mask_counts(a: Column, b: Column, threshold: float) -> Column:
    """Struct (inter, a, b) of pixels above the threshold in both, in a and in b."""
    hit = lambda v: (v > threshold).cast("int")
    count = lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v)
    return F.struct(count(F.zip_with(a, b, lambda p, q: hit(p) * hit(q))).alias("inter"), count(F.transform(a, hit)).alias("a"), count(F.transform(b, hit)).alias("b"))
