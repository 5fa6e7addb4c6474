"""Ordered scans against their plain sequential forms."""

import numpy as np
import pytest

from tallyplan.operators import selection as S
from tallyplan.plans import selection as P
from tallyplan.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def geometry(a, b):
    inter = max(0, min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])) * max(0, min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]))
    areas = a["w"] * a["h"], b["w"] * b["h"]
    d2 = (2 * a["x"] + a["w"] - 2 * b["x"] - b["w"]) ** 2 + (2 * a["y"] + a["h"] - 2 * b["y"] - b["h"]) ** 2
    diagonal = min(a["w"] ** 2 + a["h"] ** 2, b["w"] ** 2 + b["h"] ** 2)
    return inter, sum(areas) - inter, min(areas), d2, diagonal


def rows_of(df, plans=(0, 1, 2)):
    return sorted((r.asDict() for r in df.where(f"plan_id in {plans}").collect()), key=lambda r: tuple(r["rank"]))


def test_evicting_scan_equals_the_sequential_one(spark):
    rng = np.random.default_rng(3)
    for n in (2, 9, 40):
        for _ in range(3):
            wins = {(a, b) for a, b in rng.integers(0, n, (3 * n, 2)).tolist() if a != b}
            wins |= {(k, k + 1) for k in range(n - 1) if k % 3}
            selected = []
            for c in range(n):
                if any((e, c) in wins for e in selected):
                    continue
                selected = [e for e in selected if (c, e) not in wins] + [c]
            nodes = spark.createDataFrame([(k, k) for k in range(n)], "id long, rank long")
            got = S.evicting_scan(nodes, spark.createDataFrame(sorted(wins), "winner long, loser long"))
            assert sorted(r.id for r in got.collect()) == sorted(selected)


def test_ordered_scan_without_pairs(spark):
    from pyspark.sql import functions as F

    nodes = spark.createDataFrame([(1,), (2,)], "id long")
    assert S.ordered_scan(nodes, spark.createDataFrame([], "first long, id long"), F.count("*") > 0).count() == 2
    assert S.ordered_scan(nodes.limit(0), spark.createDataFrame([], "first long, id long"), F.count("*") > 0).count() == 0


@pytest.mark.parametrize("most", [1, 3])
def test_ordered_scan_equals_the_sequential_one(spark, most):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(most)
    n = 60
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (4 * n, 2)).tolist() if a != b} | {(k, k + 1) for k in range(40, 55)}
    kept = []
    for k in range(n):
        if sum((j, k) in pairs for j in kept) < most:
            kept.append(k)
    nodes = spark.createDataFrame([(k,) for k in range(n)], "id long")
    got = S.ordered_scan(nodes, spark.createDataFrame(sorted(pairs), "first long, id long"), F.count("*") >= most)
    assert sorted(r.id for r in got.collect()) == kept


def test_a_pile_settles_at_once(spark, monkeypatch):
    """10,000 boxes in one place, and 60 that differ by a pixel: few rounds, and no pairs of equal boxes."""
    from pyspark.sql import functions as F

    rounds, real = [], S.cut
    monkeypatch.setattr(S, "cut", lambda df: rounds.append(1) or real(df))
    pile = spark.range(10_000).selectExpr("id", "id AS rank", "1L AS plan_id", "5L AS x", "6L AS y", "20L AS w", "30L AS h")
    assert [r.id for r in S.suppress(pile, ["plan_id"], 85, 250, ["plan_id"]).collect()] == [0] and len(rounds) < 10
    rounds.clear()
    near = spark.range(60).selectExpr("id", "id AS rank", "1L AS plan_id", "id % 8 AS x", "id % 5 AS y", "200L AS w", "300L AS h")
    assert [r.id for r in S.contained(near, ["plan_id"], 80).collect()] == [0] and len(rounds) < 10
    rounds.clear()
    kept = S.alternatives_within(pile, ["plan_id"], 16, lambda a, b: F.lit(True)).collect()
    assert sorted(r.id for r in kept) == list(range(16)) and len(rounds) < 50


def test_raw_dedupe(spark):
    rng = np.random.default_rng(5)
    rows = [(f"{k:03d}", int(rng.integers(2)), int(100 + rng.integers(3)), int(100 + rng.integers(2)), 40, 30, int(rng.integers(2)), int(50 + 10 * rng.integers(8))) for k in range(60)]
    df = spark.createDataFrame([(i, i, 1, t, x, y, w, h, g, s) for i, t, x, y, w, h, g, s in rows], "id string, rank string, plan_id long, template_id long, x long, y long, w long, h long, gray long, scale long")
    kept = []
    for i, t, x, y, w, h, g, s in rows:
        me = dict(x=x, y=y, w=w, h=h)
        twins, near, plain = 0, 0, False
        for j, u, q, r, k, m, gg, ss in kept:
            if u != t:
                continue
            inter, union, least, d2, diagonal = geometry(dict(x=q, y=r, w=k, h=m), me)
            near += d2 * 16 <= (w * w + h * h) * 4
            if inter * 100 >= union * 98 or (inter * 1000 >= least * 995 and d2 * 10_000 <= diagonal * 64):
                twins += 1
                plain |= not (g and gg and abs(s - ss) >= 9)
        if twins and (plain or near >= 3):
            continue
        kept.append((i, t, x, y, w, h, g, s))
    got = sorted(r.id for r in S.raw_duplicates(df, ["plan_id", "template_id"]).collect())
    assert got == [k[0] for k in kept] and len(got) < 60


def sequential(rows, drops):
    kept = []
    for c in rows:
        if not drops([k for k in kept if k["plan_id"] == c["plan_id"]], c):
            kept.append(c)
    return {k["hit_id"] for k in kept}


def holds(a, b):
    return geometry(a, b)[0] * 100 >= b["w"] * b["h"] * 92


def same_place(a, b):
    inter, _, least, d2, diagonal = geometry(a, b)
    return a["template_id"] == b["template_id"] and a["source"] == b["source"] and inter * 100 >= least * 72 and d2 * 10_000 <= diagonal * 4 * 484


@pytest.mark.parametrize("name", ["nms_greedy", "raw_local_alternatives", "seed_groups"])
def test_queries_equal_sequential_scans(spark, name):
    got = {r.hit_id: r for r in QUERIES[name](spark, DATA).collect()}
    if name == "nms_greedy":
        rows = rows_of(P.by_match(spark, DATA))

        def drops(kept, c):
            return any(k["template_id"] == c["template_id"] and geometry(k, c)[0] * 100 > geometry(k, c)[1] * 85 for k in kept)

    elif name == "raw_local_alternatives":
        rows = [r for r in rows_of(P.by_match(spark, DATA)) if r["gray"]]

        def drops(kept, c):
            return sum(same_place(k, c) for k in kept) >= 16

    else:
        rows = [r for r in rows_of(P.by_quality(spark, DATA)) if 5 <= r["template_id"] <= 12]

        def drops(kept, c):
            return any(geometry(k, c)[3] <= 4 * 24 * 24 for k in kept)

    mine = {r["hit_id"] for r in rows}
    if name == "seed_groups":
        assert {h for h, r in got.items() if h in mine and r.seed == h} == sequential(rows, drops) and mine <= set(got)
    else:
        assert set(got) & mine == sequential(rows, drops)


def test_coalesced_windows(spark):
    got = {r.hit_id for r in QUERIES["search_windows_coalesced"](spark, DATA).collect()}
    rows = [{**r, "x": r["x"] - r["ink_share"], "y": r["y"] - 20, "w": r["w"] + 2 * r["ink_share"], "h": r["h"] + 40} for r in rows_of(P.by_match(spark, DATA))]
    rows.sort(key=lambda r: (-r["w"] * r["h"], r["x"], r["y"], r["hit_id"]))
    assert {h for h in got if h in {r["hit_id"] for r in rows}} == sequential(rows, lambda kept, c: any(holds(k, c) for k in kept))


def test_local_winners(spark):
    boxes = P.by_quality(spark, DATA).select(*P.SIDE).where("plan_id in (0, 1)")
    wins = {(r.winner, r.loser) for r in P.dominating(boxes).collect()}
    order = [r.id for r in sorted(boxes.collect(), key=lambda r: tuple(r["rank"]))]
    assert wins
    selected = []
    for c in order:
        if not any((e, c) in wins for e in selected):
            selected = [e for e in selected if (c, e) not in wins] + [c]
    assert {r.id for r in S.evicting_scan(boxes, P.dominating(boxes)).collect()} == set(selected)


def test_satellites_are_apart(spark):
    got = [r.hit_id for r in QUERIES["satellites"](spark, DATA).collect()]
    rows = {r["hit_id"]: r for r in rows_of(P.by_quality(spark, DATA))}
    mine = [rows[h] for h in got if h in rows]
    for k, a in enumerate(mine):
        for b in mine[:k]:
            if a["plan_id"] == b["plan_id"]:
                inter, union, least, *_ = geometry(a, b)
                assert not (inter > 0 and (inter * 100 >= union * 30 or inter * 100 >= least * 60))
    assert mine


def nearly_equal(a, b):
    inter, union, least, *_ = geometry(a, b)
    even = all(max(a[s], b[s]) * 100 <= min(a[s], b[s]) * 115 for s in "wh")
    return inter > 0 and inter * 100 >= union * 88 and inter * 100 >= least * 94 and even


def sharing(a, b):
    inter, _, least, *_ = geometry(a, b)
    return inter > 0 and inter * 100 >= least * 45


def holding(a, b):
    return geometry(a, b)[0] * 100 >= b["w"] * b["h"] * 80


@pytest.mark.parametrize("name", ["gray_alternatives", "sockets_deduped", "grid_cells"])
def test_reviews_equal_sequential_scans(spark, name):
    rows = [r.asDict() for r in P.measured(spark, DATA).where("plan_id in (0, 1)").collect()]
    if name == "gray_alternatives":
        rows = sorted((r for r in rows if r["gray"]), key=lambda r: (-((r["verif"] + r["match"] + r["context"]) * 10 + r["purity"] * 7), r["y"], r["x"], r["hit_id"]))
        same = nearly_equal
    elif name == "sockets_deduped":
        rows = sorted((r for r in rows if 5 <= r["template_id"] <= 12), key=lambda r: (-r["text"], -r["verif"], -r["match"], r["y"], r["x"], r["hit_id"]))
        same = sharing
    else:
        rows = [{**r, "w": r["w"] * (1 + int(r["hit_id"].split("-")[1]))} for r in rows if 15 <= r["template_id"] <= 22]
        rows.sort(key=lambda r: (-(r["w"] * r["h"]), r["y"], r["x"], r["hit_id"]))
        same = holding
    mine = {r["hit_id"] for r in rows}
    got = {r.hit_id for r in QUERIES[name](spark, DATA).collect()}
    assert got & mine == sequential(rows, lambda kept, c: any(same(k, c) for k in kept))
