"""Plans of 1,024 pixels a side, drawn from embeddings: 64 vectors are a plan's cells of 128 pixels, each with strokes and a symbol.

A positive entry is a horizontal stroke of its block of 16 pixels, a negative one (of another order of the entries) a vertical
stroke; neighbouring strokes make lines. The symbol's kind is the label, its place and turn come from entries.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyplan.operators import tiles as T
from tallyplan.operators import variants as V
from tallyplan.plans.base import table

CELL, ACROSS = 128, 8
SIZE = CELL * ACROSS
STROKE = 0.1


def _symbols() -> dict[int, np.ndarray]:
    """The symbols by template: a frame with a diagonal, a ring, and a frame like the first one with an arm on its right."""
    frame = np.zeros((20, 20), dtype=bool)
    frame[[0, 1, -2, -1]] = frame[:, [0, 1, -2, -1]] = True
    frame |= np.eye(20, dtype=bool)
    y, x = np.mgrid[:22, :22]
    ring = np.abs((2 * y - 21) ** 2 + (2 * x - 21) ** 2 - 300) <= 120
    armed = np.zeros((20, 30), dtype=bool)
    armed[:, :20] |= frame
    armed[8:12, 20:] = True
    return {0: frame, 1: ring, 2: armed}


SYMBOLS = _symbols()
#: The turned symbols that are drawn.
TURNED = {(t, q): V.turned(mask, 90 * q) for t, mask in SYMBOLS.items() for q in range(4)}


def cell_mask(entries: np.ndarray, label: int, strokes: bool = True) -> np.ndarray:
    """What one vector draws."""
    mask = np.zeros((CELL, CELL), dtype=bool)
    e = entries.astype(np.float64)
    if strokes:
        for k in np.flatnonzero(e > STROKE).tolist():
            mask[k // 8 * 16 + 5, k % 8 * 16 : k % 8 * 16 + 16] = True
        for k in np.flatnonzero(e[(np.arange(64) * 7 + 3) % 64] < -STROKE).tolist():
            mask[k // 8 * 16 : k // 8 * 16 + 16, k % 8 * 16 + 10] = True
    number = np.floor(np.abs(e) * 1000).astype(np.int64)
    r, c, image = int(number[0] % 98), int(number[1] % 98), TURNED[label % 3, int(number[3] % 4)]
    mask[r : r + image.shape[0], c : c + image.shape[1]] |= image
    return mask


def plans(spark, d, strokes: bool = True) -> DataFrame:
    """The raster of all plans, with their strokes or of symbols alone; vectors of another length than 64 and those with null entries draw nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.portions(batches):
            out = []
            for vec_id, entries, label in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "embedding", "label")), strict=True):
                if entries is None or len(entries) != 64 or None in entries:
                    continue
                r, c = vec_id % 64 // ACROSS * CELL, vec_id % ACROSS * CELL
                out.append((vec_id // 64, SIZE, SIZE, r, c, cell_mask(np.array(entries, np.float32), label or 0, strokes)))
            yield T.pieces_batch(out)

    # few bytes are much to draw: dealt out, so that a small file is not one task's work
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label").repartition("vec_id").mapInArrow(run, T.PIECES)


_GLYPHS = ", ".join(f"({t}, {q}, {r}, {c})" for (t, q), mask in TURNED.items() for r, c in np.argwhere(mask).tolist())
#: The ink of all plans as rows (plan_id, r, c).
INK = f"""glyphs(t, q, dr, dc) AS (VALUES {_GLYPHS}),
 vec AS (SELECT vec_id, vec_id // 64 AS plan_id, vec_id % 64 // 8 * 128 AS r0, vec_id % 8 * 128 AS c0, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label % 3 AS t FROM embeddings),
 blocks AS (SELECT plan_id, r0 + k // 8 * 16 AS r, c0 + k % 8 * 16 AS c, e[k + 1] > {STROKE} AS across, e[(k * 7 + 3) % 64 + 1] < -{STROKE} AS down FROM vec, range(64) b(k)),
 ink AS (SELECT plan_id, r + 5 AS r, c + i AS c FROM blocks, range(16) s(i) WHERE across UNION SELECT plan_id, r + i, c + 10 FROM blocks, range(16) s(i) WHERE down
  UNION SELECT plan_id, r0 + CAST(floor(abs(e[1]) * 1000) AS BIGINT) % 98 + dr, c0 + CAST(floor(abs(e[2]) * 1000) AS BIGINT) % 98 + dc FROM vec JOIN glyphs g ON g.t = vec.t AND g.q = CAST(floor(abs(e[4]) * 1000) AS BIGINT) % 4)"""
