"""Whole plans in tiles against plain models of the same masks, at several tile sizes."""

import numpy as np
import pytest

from tallyplan.operators import lines as L
from tallyplan.operators import regions as G
from tallyplan.operators import tiles as T


def raster(spark, plans, cuts=False):
    """A raster of ``plans {plan_id: mask}``, whole or cut into pieces that overlap."""
    rows = []
    for plan, mask in plans.items():
        h, w = mask.shape
        boxes = [(0, 0, h, w)] if not cuts else [(int(r), int(c), int(min(h - r, 61)), int(min(w - c, 47))) for r in range(0, h, 53) for c in range(0, w, 47)]
        for r, c, a, b in boxes:
            part = mask[r : r + a, c : c + b]
            rows.append((plan, h, w, r, c, a, b, bytearray(T.packed(part))))
    return spark.createDataFrame(rows, T.PIECES)


def flood(mask):
    """(pixels, x, y, w, h, sum_x, sum_y) of the components by flood fill, by first pixel."""
    left, out = mask.copy(), {}
    for r, c in np.argwhere(mask).tolist():
        if not left[r, c]:
            continue
        left[r, c] = False
        stack, seen = [(r, c)], []
        while stack:
            i, j = stack.pop()
            seen.append((i, j))
            for di in (-1, 0, 1):
                for dj in (-1, 0, 1):
                    p, q = i + di, j + dj
                    if 0 <= p < mask.shape[0] and 0 <= q < mask.shape[1] and left[p, q]:
                        left[p, q] = False
                        stack.append((p, q))
        at = np.array(seen)
        low, high = at.min(axis=0), at.max(axis=0)
        out[r, c] = (len(at), int(low[1]), int(low[0]), int(high[1] - low[1] + 1), int(high[0] - low[0] + 1), int(at[:, 1].sum()), int(at[:, 0].sum()))
    return out


def grown(mask, reach):
    out = np.zeros_like(mask)
    for r, c in np.argwhere(mask).tolist():
        out[max(0, r - reach) : r + reach + 1, max(0, c - reach) : c + reach + 1] = True
    return out


def spiral(size):
    mask = np.zeros((size, size), dtype=bool)
    r, c, dr, dc, length = 2, 2, 0, 1, size - 5
    mask[r, c] = True
    turn = 0
    while length > 2:
        for _ in range(length):
            r, c = r + dr, c + dc
            mask[r, c] = True
        dr, dc = dc, -dr
        turn += 1
        if turn > 1 and turn % 2 == 1:
            length -= 4
    return mask


def test_retiling(spark):
    rng = np.random.default_rng(0)
    mask = rng.random((150, 210)) < 0.3
    out = np.zeros_like(mask)
    for p in T.tiles(raster(spark, {5: mask}, cuts=True), 64).collect():
        out[p.r : p.r + p.h, p.c : p.c + p.w] |= T.unpacked(bytes(p.bits), p.h, p.w)
    assert (out == mask).all()
    back = T.transposed(T.transposed(raster(spark, {5: mask}))).first()
    assert (T.unpacked(bytes(back.bits), back.h, back.w) == mask).all() and (back.rows, back.columns) == mask.shape


@pytest.mark.parametrize("side", [32, 50, 256])
def test_components_over_tiles(spark, side):
    rng = np.random.default_rng(side)
    plans = {1: spiral(141), 2: rng.random((97, 130)) < 0.35, 3: np.eye(90, dtype=bool)[::-1], 4: np.zeros((40, 40), dtype=bool)}
    for dilate in (0, 2):
        want = {(p, p << 40 | r << 20 | c): v for p, mask in plans.items() for (r, c), v in flood(grown(mask, dilate)).items()}
        got = {(r.plan_id, r.component): (r.pixels, r.x, r.y, r.w, r.h, r.sum_x, r.sum_y) for r in T.components(raster(spark, plans, cuts=True), dilate, side).collect()}
        assert got == want
    assert sum(p == 1 for p, _ in want) == 1 and sum(p == 3 for p, _ in want) == 1


def plain_peaks(mask, template, threshold):
    h, w = template.shape
    n, t = template.size, template.sum()
    rows, columns = mask.shape[0] - h + 1, mask.shape[1] - w + 1
    value = np.zeros((rows, columns))
    both = np.zeros((rows, columns), dtype=int)
    for r in range(rows):
        for c in range(columns):
            part = mask[r : r + h, c : c + w]
            i, s = int((part & template).sum()), int(part.sum())
            below = (n * s - s * s) * (n * t - t * t)
            value[r, c], both[r, c] = ((n * i - s * t) / below**0.5 if below > 0 else 0.0), i
    up, across = T.peak_radius(h), T.peak_radius(w)
    out = set()
    for r, c in np.argwhere(value >= threshold).tolist():
        if value[r, c] >= value[max(0, r - up) : r + up + 1, max(0, c - across) : c + across + 1].max() - 1e-6:
            out.add((c, r, w, h, int(both[r, c]), round(float(value[r, c]), 9)))
    return out


@pytest.mark.parametrize("side", [24, 64])
def test_peaks_over_tiles(spark, side):
    rng = np.random.default_rng(1)
    cross = np.zeros((13, 9), dtype=bool)
    cross[6], cross[:, 4], cross[0, :3] = True, True, True
    ring = np.ones((16, 16), dtype=bool)
    ring[3:13, 3:13] = False
    mask = rng.random((110, 120)) < 0.06
    for r, c, t in [(0, 0, cross), (20, 58, cross), (57, 60, cross), (60, 20, ring), (94, 104, ring), (17, 90, cross), (97, 3, cross)]:
        mask[r : r + t.shape[0], c : c + t.shape[1]] |= t
    variants = [(7, 0, cross), (7, 90, np.rot90(cross, -1)), (8, 0, ring)]
    got = {}
    for r in T.template_peaks(raster(spark, {3: mask}, cuts=True), variants, 0.55, side).collect():
        got.setdefault((r.template_id, r.turn), []).append((r.x, r.y, r.w, r.h, r.common, round(r.score, 9)))
    for t, turn, template in variants:
        found = got.get((t, turn), [])
        assert len(found) == len(set(found)) and set(found) == plain_peaks(mask, template, 0.55)
    assert len(got[7, 0]) >= 5 and len(got[8, 0]) >= 2


def test_no_template_and_no_ink(spark):
    with pytest.raises(ValueError):
        T.template_peaks(raster(spark, {1: np.ones((9, 9), dtype=bool)}), [], 0.5)
    empty = raster(spark, {1: np.zeros((70, 70), dtype=bool)})
    assert T.components(empty).count() == 0 and T.template_peaks(empty, [(1, 0, np.eye(5, dtype=bool))], 0.5).count() == 0
    assert G.search_regions(empty, 20, 20).count() == 0 and L.horizontal_lines(empty).count() == 0


def plain_regions(mask, width, height):
    full = [(0, 0, mask.shape[1], mask.shape[0])]
    parts = flood(grown(mask, 4))
    if len(parts) > G.MOST_COMPONENTS:
        return full, True
    pad_x, pad_y = max(8, round(width * 1.15 + 1e-9)), max(8, round(height * 1.15 + 1e-9))
    rects = []
    for n, x, y, w, h, *_ in parts.values():
        if n >= 6:
            a, b = max(0, x - pad_x), max(0, y - pad_y)
            rects.append((a, b, min(mask.shape[1], x + w + pad_x) - a, min(mask.shape[0], y + h + pad_y) - b))
    moved = True
    while moved:
        moved, out = False, []
        for r in rects:
            for k, o in enumerate(out):
                if not (o[0] + o[2] + 4 < r[0] or r[0] + r[2] + 4 < o[0] or o[1] + o[3] + 4 < r[1] or r[1] + r[3] + 4 < o[1]):
                    x0, y0 = min(o[0], r[0]), min(o[1], r[1])
                    out[k] = (x0, y0, max(o[0] + o[2], r[0] + r[2]) - x0, max(o[1] + o[3], r[1] + r[3]) - y0)
                    moved = True
                    break
            else:
                out.append(r)
        rects = out
    if sum(w * h for _, _, w, h in rects) >= mask.size * 70 // 100:
        return full, True
    return sorted(rects), False


def test_search_regions(spark):
    rng = np.random.default_rng(6)
    sparse = np.zeros((300, 340), dtype=bool)
    for r, c in rng.integers(0, 290, (14, 2)).tolist():
        sparse[r : r + 6, c : c + 5] = True
    dense = rng.random((120, 120)) < 0.2
    crowded = np.zeros((400, 400), dtype=bool)
    crowded[::11, ::11] = True
    plans = {1: sparse, 2: dense, 3: crowded}
    got = {}
    for r in G.search_regions(raster(spark, plans, cuts=True), 9, 7, 64).collect():
        got.setdefault(r.plan_id, []).append(((r.x, r.y, r.w, r.h), r.full))
    for plan, mask in plans.items():
        boxes, full = plain_regions(mask, 9, 7)
        assert sorted(b for b, _ in got[plan]) == sorted(boxes) and {f for _, f in got[plan]} == {full}
    assert len(flood(grown(crowded, 4))) > G.MOST_COMPONENTS and len(got[1]) > 1


def test_foreground_and_gray_regions(spark):
    rng = np.random.default_rng(8)
    mask = np.zeros((500, 620), dtype=bool)
    mask[200:206, 40:600] = True  # too wide for a window of its own
    for r, c in rng.integers(0, 480, (40, 2)).tolist():
        mask[r : r + 9, c : c + 7] |= rng.random((9, 7)) < 0.7
    pieces = raster(spark, {4: mask}, cuts=True)
    boxes = [(4, int(x), int(y), int(w), int(h)) for x, y, w, h in np.column_stack([rng.integers(-20, 600, 30), rng.integers(-20, 480, 30), rng.integers(1, 300, 30), rng.integers(1, 300, 30)])]
    got = {tuple(r)[:5]: r.ink for r in G.foreground(pieces, spark.createDataFrame(boxes, "plan_id long, x long, y long, w long, h long"), 100).collect()}
    assert got == {b: int(mask[max(0, b[2]) : max(0, b[2] + b[4]), max(0, b[1]) : max(0, b[1] + b[3])].sum()) for b in boxes}

    width, height = 14, 12
    score = lambda w, h: abs(np.log((w * h + 1) / (width * height))) + 0.35 * abs(np.log((w / h + 0.05) / (width / height)))
    pad_x, pad_y = max(6, int(width * 0.85 + 0.5)), max(6, int(height * 0.85 + 0.5))
    want = {}
    for n, x, y, w, h, *_ in flood(mask).values():
        if n < 6:
            continue
        a, b = max(0, x - pad_x), max(0, y - pad_y)
        w1, h1 = min(620, x + w + pad_x) - a, min(500, y + h + pad_y) - b
        if n <= max(120, width * height * 8) and w <= 80 and h <= 80:
            found = [((a, b, w1, h1), score(w, h), n)]
        else:
            found = []
            for ty in range(b, b + h1, 53):
                for tx in range(a, a + w1, 53):
                    tile = (tx, ty, min(96, 620 - tx), min(96, 500 - ty))
                    ink = int(mask[ty : ty + tile[3], tx : tx + tile[2]].sum())
                    if ink >= 12:
                        found.append((tile, score(*tile[2:]) + 0.12, min(n, ink)))
        for box, s, area in found:
            want[box] = min(want.get(box, (9e9, 0)), (round(s, 9), -area))
    got = {(r.x, r.y, r.w, r.h): (round(r.score, 9), -r.area) for r in G.gray_regions(pieces, width, height, 100).collect()}
    assert got == want and len(got) < G.GRAY_MOST_REGIONS


def test_gray_regions_keep_360(spark):
    mask = np.zeros((900, 900), dtype=bool)
    for r in range(5):
        for c in range(5):
            mask[5 + r :: 30, 5 + c :: 30] = True
    pieces = raster(spark, {1: mask})
    base = G.gray_regions(pieces, 8, 8, 300)
    assert base.count() == G.GRAY_MOST_REGIONS
    more = {(r.x, r.y) for r in G.gray_regions(pieces, 8, 8, 300, supplement=5).collect()}
    assert len(more) == G.GRAY_MOST_REGIONS + 5


def planted_table(mask, x, y, columns, rows, broken=True):
    xs, ys = np.cumsum([x, *columns]), np.cumsum([y, *rows])
    for yy in ys:
        mask[yy : yy + 2, xs[0] : xs[-1] + 2] = True
    for xx in xs:
        mask[ys[0] : ys[-1] + 2, xx : xx + 2] = True
    if broken:
        mask[ys[1] : ys[1] + 2, xs[1] + 30 : xs[1] + 34] = False
    return {(int(a), int(b), int(c - a), int(d - b)) for a, c in zip(xs, xs[1:], strict=False) for b, d in zip(ys, ys[1:], strict=False)}


@pytest.mark.parametrize("side", [64, 200])
def test_tables_have_their_cells(spark, side):
    rng = np.random.default_rng(side)
    mask = rng.random((420, 520)) < 0.01
    want = planted_table(mask, 37, 41, [90, 120, 60], [50, 44, 70])
    want |= planted_table(mask, 330, 250, [80, 70], [60, 55], broken=False)
    # a cell over two columns: the wall between them goes in the first row
    mask[41 + 8 : 41 + 48, 37 + 90 + 120 : 37 + 90 + 122] = False
    want -= {(127, 41, 120, 50), (247, 41, 60, 50)}
    want |= {(127, 41, 180, 50)}
    pieces = raster(spark, {9: mask}, cuts=True)
    h, v = L.horizontal_lines(pieces, side=side), L.vertical_lines(pieces, side=side)
    assert h.count() == 7 and v.count() == 7
    cells = [(r.x, r.y, r.w, r.h) for r in L.lattice_cells(L.crossings(h, v)).collect()]
    near = lambda a, b: all(abs(p - q) <= 2 for p, q in zip(a, b, strict=True))
    assert len(cells) == len(want) and all(any(near(c, w) for w in want) for c in cells)


def test_runs_across_tiles(spark):
    mask = np.zeros((10, 300), dtype=bool)
    mask[2, 10:55] = mask[2, 58:99] = mask[2, 120:161] = True
    mask[5, 0:300:2] = True
    pieces = raster(spark, {1: mask})
    for side in (32, 64, 256):
        assert sorted(tuple(r) for r in L.joined(L.runs(pieces, side), 0).collect()) == sorted((1, r, a, b) for r, a, b in zip(*(x.tolist() for x in T._runs(mask)), strict=True))
        lines = L.horizontal_lines(pieces, side=side)
        assert sorted((r.x, r.y, r.w, r.h) for r in lines.collect()) == [(10, 2, 89, 1), (120, 2, 41, 1)]


def test_a_task_holds_the_pixels_of_few_rows():
    """Batches of 3,000 pieces, as large as Spark makes them, are cut and turned without all their masks at once."""
    import tracemalloc

    rng = np.random.default_rng(2)
    mask = rng.random((128, 128)) < 0.1
    batch = T.pieces_batch([(k // 64, 1024, 1024, k % 64 // 8 * 128, k % 8 * 128, mask) for k in range(3000)])
    tracemalloc.start()
    pieces = sum(b.num_rows for b in T._cut(256, 0, 0)(iter([batch])))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert pieces == 3000 and peak < 16e6
    assert [b.num_rows for b in T.portions(iter([batch.slice(0, 0), batch.slice(0, 200)]))] == [0, 128, 72]
