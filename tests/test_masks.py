"""Variants, displaced masks and promotions against plain pixel counting."""

import math

import numpy as np
import pytest

from tallyplan.operators import masks as M
from tallyplan.operators import tiles as T
from tallyplan.operators import variants as V
from tests.test_tiles import raster


def plain_turn(mask, degrees):
    """Pixel by pixel: turn the frame's pixel back about the middle and look it up."""
    h, w = mask.shape
    a = math.radians(degrees)
    rows = max(1, round(w * abs(math.sin(a)) + h * abs(math.cos(a))))
    columns = max(1, round(h * abs(math.sin(a)) + w * abs(math.cos(a))))
    out = np.zeros((rows, columns), dtype=bool)
    for y in range(rows):
        for x in range(columns):
            dy, dx = y - rows / 2, x - columns / 2
            u = math.cos(a) * dx + math.sin(a) * dy + w / 2
            v = math.cos(a) * dy - math.sin(a) * dx + h / 2
            i, j = (math.floor(math.floor(t * 1024 + 0.5) / 1024 + 0.5) for t in (v, u))
            out[y, x] = 0 <= i < h and 0 <= j < w and mask[i, j]
    return out


@pytest.mark.parametrize("degrees", sorted({*V.QUARTERS, *V.SLANTED, 10, 200}))
def test_turns(degrees):
    rng = np.random.default_rng(degrees)
    for shape in ((7, 7), (12, 5), (3, 20)):
        mask = rng.random(shape) < 0.5
        if degrees % 90:
            assert (V.turned(mask, degrees) == plain_turn(mask, degrees)).all()
        else:
            assert (V.turned(mask, degrees) == np.rot90(mask, -degrees // 90)).all()
        assert V.turned(mask, degrees).shape == V.frame(*shape, degrees)


def test_a_turned_bar_stays_a_bar():
    bar = np.zeros((21, 21), dtype=bool)
    bar[9:12] = True
    slanted = V.turned(bar, 45)
    at = np.argwhere(slanted)
    assert abs(np.corrcoef(at[:, 0], at[:, 1])[0, 1]) > 0.9 and abs(len(at) - bar.sum()) < 12
    assert np.corrcoef(at[:, 0], at[:, 1])[0, 1] > 0  # clockwise: the bar's right end goes down


def test_variants_have_their_turns():
    mask = np.eye(10, dtype=bool)
    plain = V.variants(1, mask)
    assert len(plain) == 3 * 2 * 4
    slanted = V.variants(1, mask, scales=(50, 80, 120), slanted=True)
    assert {(v.scale, v.turn) for v in slanted} == {(s, t) for s in (50, 80, 120) for t in V.QUARTERS + (V.SLANTED if s >= 80 else ())}
    label = V.variants(1, mask, scales=(70, 100, 120), label=True, mirror=False)
    assert {(v.scale, v.turn) for v in label} == {(s, t) for s in (70, 100, 120) for t in V.QUARTERS + (V.SLANTED_LABELS if s == 100 else ())}
    assert V.variants(1, np.zeros((4, 4), dtype=bool)) == []
    assert V.resized(mask, 90).shape == (9, 9)


@pytest.mark.parametrize("size", [(9, 7), (20, 64), (15, 65), (11, 130)])
def test_counts_at_displacements(size):
    rng = np.random.default_rng(size[1])
    template, other = rng.random(size) < 0.5, rng.random(size) < 0.2
    plan = rng.random((size[0] + 6, size[1] + 9)) < 0.4
    seen = 0
    for r, c, (a, b), ink in M.common_at(plan, template, other):
        part = plan[r : r + size[0], c : c + size[1]]
        assert (a, b, ink) == ((part & template).sum(), (part & other).sum(), part.sum())
        seen += 1
    assert seen == 7 * 10


def test_crops_over_tiles(spark):
    rng = np.random.default_rng(3)
    mask = rng.random((150, 170)) < 0.3
    boxes = [(k, 2, int(x), int(y), int(w), int(h), f"n{k}") for k, (x, y, w, h) in enumerate(np.column_stack([rng.integers(-10, 170, 25), rng.integers(-10, 150, 25), rng.integers(1, 90, 25), rng.integers(1, 90, 25)]))]
    got = M.crops(raster(spark, {2: mask}, cuts=True), spark.createDataFrame(boxes, "id long, plan_id long, x long, y long, w long, h long, name string"), 5, 32).collect()
    assert len(got) == 25
    wide = np.pad(mask, 200)
    for r in got:
        want = wide[r.y + 195 : r.y + r.h + 205, r.x + 195 : r.x + r.w + 205]
        assert (T.unpacked(bytes(r.bits), r.h + 10, r.w + 10) == want).all() and r.name == f"n{r.id}"


def plain_best(mask, x, y, rule, verification):
    """The best place by counting pixels of the whole plan."""
    plan = T.dilated(mask, 1) if rule.grown else mask
    wide = np.pad(plan, 300)
    t, e, (h, w) = rule.parent.mask, rule.extension, rule.parent.mask.shape
    margin = max(3, round(max(h, w) * 0.4))
    best = None
    for dy in range(-rule.radius, rule.radius + 1):
        for dx in range(-rule.radius, rule.radius + 1):
            px, py = x + dx, y + dy
            roi = wide[py + 300 : py + 300 + h, px + 300 : px + 300 + w]
            around = wide[py + 300 - margin : py + 300 + h + margin, px + 300 - margin : px + 300 + w + margin]
            both, ink = int((roi & t).sum()), int(roi.sum())
            share = int((roi & e).sum()) / int(e.sum())
            if share * 100 < rule.extra - 1e-9 or not ink:
                continue
            match, coverage, purity, context = both / (ink * int(t.sum())) ** 0.5, both / int(t.sum()), both / ink, both / int(around.sum())
            score = 0.45 * match + 0.2 * coverage + 0.15 * purity + 0.2 * context
            if purity * 100 < rule.least_purity or context * 100 < rule.least_context or score * 100 < rule.least_verification or score < verification - rule.drop / 100:
                continue
            key = (share, round(score, 9), round(match, 9), -dy, -dx)
            if best is None or key > best[0]:
                best = key, (px, py, share, coverage, purity, context, score)
    return best and best[1]


@pytest.mark.parametrize("grown", [False, True])
def test_promotions(spark, grown):
    child, parent = np.zeros((12, 12), dtype=bool), np.zeros((12, 20), dtype=bool)
    child[[0, -1]] = child[:, [0, -1]] = True
    parent[:, :12] |= child
    parent[5:7, 12:] = True  # an arm makes the frame the fuller symbol
    found = M.rules(V.variants(1, child, scales=(100,), mirror=False), V.variants(2, parent, scales=(100,), mirror=False), 30, 4, grown=grown, least_context=10, drop=50 if grown else 30, least_purity=20 if grown else 58, least_verification=40 if grown else 62)
    assert found and {r.parent.turn for r in found} == {0, 90, 180, 270}
    rng = np.random.default_rng(5)
    mask = rng.random((300, 320)) < 0.01
    places = [(30, 40, 0), (120, 60, 90), (200, 200, 180), (60, 250, 270), (250, 30, None), (0, 0, 0), (300, 280, None)]
    hits = []
    for k, (x, y, turn) in enumerate(places):
        mask[y : y + 12, x : x + 12] |= child[: 300 - y, : 320 - x]
        if turn is not None:
            rule = next(r for r in found if r.child == (1, 100, 0, False) and r.parent.turn == turn)
            ext = rule.extension
            for i, j in np.argwhere(ext).tolist():
                if 0 <= y - rule.y + i < 300 and 0 <= x - rule.x + j < 320:
                    mask[y - rule.y + i, x - rule.x + j] = True
        hits.append((k, 9, 1, 100, 0, False, x + int(rng.integers(-2, 3)), y + int(rng.integers(-2, 3)), 12, 12, 0.8))
    hits.append((99, 9, 5, 100, 0, False, 40, 40, 10, 10, 0.7))
    df = spark.createDataFrame(hits, "id long, plan_id long, template_id long, scale int, turn int, mirrored boolean, x long, y long, w int, h int, verification double")
    got = {r.id: r for r in M.promote(raster(spark, {9: mask}, cuts=True), df, found).collect()}
    assert sorted(got) == sorted(h[0] for h in hits)
    promoted = 0
    for h in hits:
        r = got[h[0]]
        options = []
        for k, rule in enumerate(q for q in found if q.child == tuple(h[2:6])):
            fit = plain_best(mask, h[6] - rule.x, h[7] - rule.y, rule, h[10])
            if fit:
                t = rule.parent.mask
                options.append(((fit[2], round(fit[6], 9)), -k, fit, rule))
        if not options:
            assert r.promoted_from is None and (r.template_id, r.x, r.y) == (h[2], h[6], h[7])
            continue
        promoted += 1
        best = max(o[0] for o in options)
        assert any(o[0] == best and (r.x, r.y, r.turn) == (*o[2][:2], o[3].parent.turn) and np.allclose((r.extra, r.coverage, r.purity, r.context, r.verification), o[2][2:]) for o in options)
        assert r.promoted_from == 1 and r.template_id == 2
    assert promoted >= 4 and (grown or got[4].promoted_from is None) and got[99].promoted_from is None


def test_counts_of_many_columns_at_once_are_those_of_few():
    rng = np.random.default_rng(8)
    plan, template = rng.random((30, 90)) < 0.4, rng.random((11, 40)) < 0.5
    whole = list(M.counts_at(plan, template, at_once=99))
    few = list(M.counts_at(plan, template, at_once=3))
    assert len(whole) == 1 and [f for f, _, _ in few] == list(range(0, 51, 3))
    assert (np.concatenate([n for _, (n,), _ in few]) == whole[0][1][0]).all() and (np.concatenate([n for _, _, n in few]) == whole[0][2]).all()


def test_hits_are_found_once_for_promotions(spark):
    """Children, their crops and those that stay come from one pass over the hits."""
    child, parent = np.ones((6, 6), dtype=bool), np.ones((6, 9), dtype=bool)
    found = M.rules(V.variants(1, child, scales=(100,), mirror=False), V.variants(2, parent, scales=(100,), mirror=False), 30, 2)
    passed = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    hits = spark.createDataFrame([(k, 9, k % 2 + 1, 100, 0, False, 10 * k, 20, 6, 6, 0.8) for k in range(6)], "id long, plan_id long, template_id long, scale int, turn int, mirrored boolean, x long, y long, w int, h int, verification double")
    out = M.promote(raster(spark, {9: np.ones((60, 80), dtype=bool)}), hits.mapInArrow(run, hits.schema), found).collect()
    assert len(out) == 6 and passed.value == 6
