"""Operators against models written in plain Python."""

import itertools

import numpy as np

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyplan.functions import geometry as G
from tallyplan.functions import text as X
from tallyplan.operators import graph, layout, spatial, store, takeoff
from tallyplan.operators.cascade import cascade
from tallyplan.plans import spatial as P
from tallyplan.plans.base import hits
from tallyplan.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"


def inter(a, b):
    return max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))


@pytest.mark.parametrize("a,b,expected", [((10, 10, 50, 50), (10, 10, 50, 50), (2500, 1.0, 1.0)), ((0, 0, 10, 10), (20, 20, 10, 10), (0, 0.0, 0.0)), ((0, 0, 20, 20), (10, 10, 20, 20), (100, 100 / 700, 100 / 400)), ((0, 0, 40, 40), (10, 10, 10, 10), (100, 100 / 1600, 1.0))])
def test_geometry(spark, a, b, expected):
    df = spark.createDataFrame([(*a, *b)], "x_a long, y_a long, w_a long, h_a long, x_b long, y_b long, w_b long, h_b long")
    p, q = G.Box("_a"), G.Box("_b")
    row = df.select(G.intersection(p, q), G.iou(p, q), G.iom(p, q), G.iou(q, p)).first()
    assert row[0] == expected[0] and row[1] == pytest.approx(expected[1]) and row[2] == pytest.approx(expected[2]) and row[1] == row[3]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 200), st.integers(1, 90), st.integers(1, 90)), min_size=1, max_size=30))
def test_spatial_join_finds_each_pair_once(spark, boxes):
    df = spark.createDataFrame([(k, 1, *b) for k, b in enumerate(boxes)], "id long, plan_id long, x long, y long, w long, h long")
    got = sorted((r.id_a, r.id_b) for r in spatial.self_pairs(df, spatial.overlapping, ["plan_id"], "id").collect())
    assert got == sorted((i, j) for i, j in itertools.combinations(range(len(boxes)), 2) if inter(boxes[i], boxes[j]) > 0)


def test_spatial_join_has_no_nested_loop(spark):
    plan = P.cluster_edges(hits(spark, DATA))._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_pushdown(spark):
    plan = QUERIES["session_user_join"](spark, DATA)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan


def scan(order, pairs):
    near = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs}
    kept = []
    for k in order:
        if not any((k, o) in near for o in kept):
            kept.append(k)
    return sorted(kept)


@settings(max_examples=6, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 14), st.integers(0, 14)).filter(lambda p: p[0] < p[1]), max_size=25))
def test_greedy_winners_equals_scan(spark, pairs):
    nodes = spark.createDataFrame([(k, k * 7 % 15) for k in range(15)], "id long, rank long")
    edges = spark.createDataFrame(list(pairs), "a long, b long")
    assert sorted(r.id for r in graph.greedy_winners(nodes, edges).collect()) == scan(sorted(range(15), key=lambda k: k * 7 % 15), pairs)


def test_bridge_does_not_collapse_neighbours(spark):
    nodes = spark.createDataFrame([(1, -70), (2, -58), (3, -69)], "id long, rank long")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert sorted(r.id for r in graph.greedy_winners(nodes, edges).collect()) == [1, 3]


def test_greedy_matching_equals_scan(spark):
    pairs = [(a, b, (a * 31 + b * 17) % 23) for a in range(9) for b in range(9) if (a + b) % 3]
    used_a, used_b, expected = set(), set(), []
    for a, b, c in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), expected.append((a, b, c))
    got = graph.greedy_matching(spark.createDataFrame(pairs, "a long, b long, cost long")).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_greedy_matching_settles_beyond_its_rounds(spark):
    pairs = [(a, b, 5) for a in range(7) for b in range(7)]
    got = graph.greedy_matching(spark.createDataFrame(pairs, "a long, b long, cost long"), rounds=3).collect()
    assert sorted(map(tuple, got)) == [(k, k, 5) for k in range(7)]


def test_merged_rectangles_do_not_overlap(spark):
    rows = QUERIES["merged_rectangles"](spark, DATA).collect()
    assert not any((p.plan_id, p.template_id) == (q.plan_id, q.template_id) and inter((p.x, p.y, p.w, p.h), (q.x, q.y, q.w, q.h)) for p, q in itertools.combinations(rows, 2))


def test_merged_rectangles_equal_the_sequential_merge(spark):
    rng = np.random.default_rng(2)
    boxes = [(f"{k:03d}", int(k % 2), int(x), int(y), int(w), int(h)) for k, (x, y, w, h) in enumerate(np.column_stack([rng.integers(0, 900, 70), rng.integers(0, 900, 70), rng.integers(1, 90, 70), rng.integers(1, 90, 70)]).tolist())]
    boxes += [("900", 0, *boxes[0][2:]), ("901", 0, *boxes[0][2:])]
    want = set()
    for plan in (0, 1):
        left = [b[2:] for b in boxes if b[1] == plan]
        done = False
        while not done:
            done = True
            for i, j in itertools.combinations(range(len(left)), 2):
                p, q = left[i], left[j]
                if inter(p, q):
                    x, y = min(p[0], q[0]), min(p[1], q[1])
                    left = [b for k, b in enumerate(left) if k not in (i, j)] + [(x, y, max(p[0] + p[2], q[0] + q[2]) - x, max(p[1] + p[3], q[1] + q[3]) - y)]
                    done = False
                    break
        want |= {(plan, *b) for b in left}
    df = spark.createDataFrame(boxes, "id string, plan_id long, x long, y long, w long, h long")
    assert {(r.plan_id, r.x, r.y, r.w, r.h) for r in graph.merge_rectangles(df, ["plan_id"]).collect()} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)], "a long, b long")
    assert {r.component for r in graph.connected_components(edges).collect()} == {0}


def test_running_mean_groups(spark):
    df = spark.createDataFrame([([10, 14, 18, 30, 33, 60],), ([],)], "v array<long>")
    rows = df.select(layout.group_by_running_mean(F.col("v"), 7).alias("g")).collect()
    assert [(g.n, g.mean) for g in rows[0].g] == [(3, 14.0), (2, 31.5), (1, 60.0)] and rows[1].g == []


def test_running_means_over_rows_equal_those_over_arrays(spark):
    values = {1: [10, 14, 18, 30, 33, 60], 2: [5], 3: [1, 2, 3, 900, 901, 5000]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "u long, v long").repartition(5)
    got = {}
    for r in layout.running_mean_groups(rows, "u", "v", 7).collect():
        got.setdefault(r.u, {})[r.k] = (r.n, r.mean)
    for k, vs in values.items():
        one = spark.createDataFrame([(vs,)], "v array<long>").select(layout.group_by_running_mean(F.col("v"), 7).alias("g")).first().g
        assert [got[k][i] for i in range(len(got[k]))] == [(g.n, g.mean) for g in one]
    assert layout.running_mean_groups(rows.limit(0), "u", "v", 7).count() == 0


def test_fair_peaks(spark):
    rows = [r for r in hits(spark, DATA).where("plan_id < 3 and template_id < 4").collect()]
    groups = {}
    for r in sorted(rows, key=lambda r: (-r.match_pct, r.y, r.x, r.hit_id)):
        groups.setdefault((r.plan_id, r.template_id), []).append(r)
    expected = set()
    for g in groups.values():
        taken = []
        for r in g:
            if len(taken) < 12 and not any(abs(r.x - t.x) < 24 and abs(r.y - t.y) < 24 for t in taken):
                taken.append(r)
        expected |= {r.hit_id for r in (taken + [r for r in g if r not in taken])[:12]}
    got = QUERIES["fair_peaks"](spark, DATA).where("plan_id < 3 and template_id < 4").collect()
    assert {r.hit_id for r in got} == expected and len(got) == len(expected)


def test_cascade_names_the_first_rule(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "v long")
    rows = cascade(df, [("low", F.col("v") < 3), ("mid", F.col("v") < 7)]).collect()
    assert [r.reason for r in rows] == ["low", "mid", None]


def test_boxes_win_over_results_and_labels_merge(spark):
    boxes = spark.createDataFrame([("01_TM", "#f00", 1), ("01_TM", "#0f0", 2), ("02_TAB", None, 3), (" ", None, 4)], "symbol string, color string, ordinal long")
    results = spark.createDataFrame([("01_TM", 99, None, 1)], "symbol string, n long, color string, ordinal long")
    got = {r.symbol: (r.n, r.color) for r in takeoff.count_by_symbol(boxes, results).collect()}
    assert got == {"01_TM": (2, "#f00"), "02_TAB": (1, None)}
    counts = spark.createDataFrame([("01_AW1", 3, 1), ("02_AW2", 4, 2)], "symbol string, n long, ordinal long")
    labels = spark.createDataFrame([("01_AW1", "Lamp  A"), ("02_AW2", "lamp a")], "symbol string, label string")
    rows = takeoff.roll_up(counts, labels).collect()
    assert [(r.label, r.n, r.symbols) for r in rows] == [("Lamp  A", 7, ["01_AW1", "02_AW2"])]
    totals = {r.label: r.n for r in takeoff.with_total(takeoff.roll_up(counts, labels)).collect()}
    assert totals["TOTAL"] == 7


def test_labels(spark):
    cases = [("GNIAZDO 1-F Z BOLCEM OCHRONNYM, 16A, IP20", "GNIAZDO 1-F Z BOLCEM OCHRONNYM 16A IP20"), ("ZESTAW GNIAZD 2x16A Sf 2x16A if SOCKET KIT", "ZESTAW GNIAZD 2x16A 3f 2x16A 1f"), ("?", None), (None, None)]
    rows = spark.createDataFrame(cases, "raw string, label string").select("label", X.clean_label(F.col("raw")).alias("got"), X.file_fragment(F.lit("  żółty a/b\nc ")).alias("f"), X.column_name(F.lit(703)).alias("c"), X.symbol_token(F.lit("tb-11")).alias("none"), X.symbol_token(F.lit("tb 11")).alias("t")).collect()
    assert all(r.got == r.label for r in rows)
    assert (rows[0].f, rows[0].c, rows[0].none, rows[0].t) == ("zolty_ab_c", "AAA", None, "TB11")


def test_store(spark):
    table = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, v string, created long")
    after = store.upsert(table, spark.createDataFrame([(2, "B", 99), (3, "c", 99)], "id long, v string, created long"), "id", ["created"])
    assert sorted(map(tuple, after.collect())) == [(1, "a", 10), (2, "B", 20), (3, "c", 99)]
    live = store.expire(table, "created", F.lit(10))
    assert [r.id for r in live.collect()] == [2]


def test_gate_counts_boxes_not_numbers(spark):
    from tallyplan.operators import evaluate as E

    kind = "box_id string, plan_id long, symbol long, x long, y long, w long, h long"
    golden = spark.createDataFrame([("a", 1, 5, 0, 0, 20, 20), ("b", 1, 5, 200, 0, 20, 20), ("c", 2, 5, 0, 0, 20, 20), ("d", 3, 5, 0, 0, 20, 20)], kind)
    candidate = spark.createDataFrame([("k", 1, 5, 3, 0, 20, 20), ("l", 1, 5, 500, 0, 20, 20), ("m", 2, 6, 2, 0, 20, 20), ("n", 3, 5, 0, 0, 20, 20)], kind)
    got = {(r.box_id, r.status) for r in E.report(golden, candidate).collect()}
    assert got == {("a", "moved"), ("b", "missing"), ("l", "extra"), ("c", "conflict"), ("m", "extra"), ("d", "matched")}
    assert {r.plan_id: r.ok for r in E.gate(golden, candidate).collect()} == {1: False, 2: False, 3: True}


def test_layer_names_read_in_the_wrong_code(spark):
    from tallyplan.functions import text as X

    wrong = "Oświetlenie Główne".encode().decode("latin-1")
    rows = spark.createDataFrame([(wrong,), ("Oświetlenie  Główne",), ("Ãa",)], "n string").select(X.layer_key(F.col("n")).alias("k")).collect()
    assert [r.k for r in rows] == ["oswietlenie głowne", "oswietlenie głowne", "aa"]


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from tallyplan.operators import lineage

    empty = SimpleNamespace(isEmpty=lambda: True)
    context = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)), getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.cut(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=context, conf={})))


def test_groups_without_overlaps_leave_the_rounds(spark, monkeypatch):
    """500 boxes of one plan that are apart are written once, while a chain on another plan is merged."""
    apart = [(f"a{k}", 1, k % 25 * 40, k // 25 * 40, 10, 10) for k in range(500)]
    chain = [(f"c{k}", 2, k * 8, k * 8, 10, 10) for k in range(40)]
    df = spark.createDataFrame(apart + chain, "id string, plan_id long, x long, y long, w long, h long")
    written, real = [], graph.cut

    def counted(rows):
        out = real(rows)
        written.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    got = {tuple(r) for r in graph.merge_rectangles(df, ["plan_id"]).select("id", "plan_id", *"xywh").collect()}
    assert got == {*apart, ("c0", 2, 0, 0, 322, 322)} and sum(written) < 540 + 4 * 40


def _merged_one_by_one(boxes):
    """The sequential merge of (id, plan, x, y, w, h), as a set."""
    done = []
    for box in boxes:
        while met := [d for d in done if d[1] == box[1] and inter(d[2:], box[2:])]:
            done = [d for d in done if d not in met]
            ids, x, y, right, bottom = zip(*((i, x, y, x + w, y + h) for i, _, x, y, w, h in [box, *met]), strict=True)
            box = (min(ids), box[1], min(x), min(y), max(right) - min(x), max(bottom) - min(y))
        done.append(box)
    return set(done)


def test_a_plan_that_merges_into_one_takes_few_rounds(spark, monkeypatch):
    """Bounds that grow meet ever more others; the tasks merge them, so that the rounds find little."""
    rng = np.random.default_rng(5)
    boxes = [(f"{k:04d}", int(k % 3), *(int(v) for v in rng.integers(0, 1200, 2)), *(int(v) for v in rng.integers(24, 41, 2))) for k in range(1800)]
    cuts, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda rows: cuts.append(1) or real(rows))
    got = {tuple(r) for r in graph.merge_rectangles(spark.createDataFrame(boxes, "id string, plan_id long, x long, y long, w long, h long"), ["plan_id"]).select("id", "plan_id", *"xywh").collect()}
    assert got == _merged_one_by_one(boxes) and len(cuts) <= 8


@pytest.mark.parametrize("few, many", [(256, 1024), (2, 3)])
def test_merging_nearby_loses_nothing(spark, monkeypatch, few, many):
    """However few boxes a task compares at a time; boxes without an extent and those with nulls stay as they are."""
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "MANY", many)
    rng = np.random.default_rng(6)
    boxes = [(int(k), int(k % 4), *(int(v) for v in rng.integers(0, 300, 2)), *(int(v) for v in rng.integers(1, 40, 2))) for k in range(60)]
    odd = [(900, 0, 5, 5, 0, 300), (901, 0, 5, 5, 300, -1), (902, None, 5, 5, 300, 300), (903, 1, None, 5, 300, 300), (None, 1, 900, 900, 30, 30)]
    df = spark.createDataFrame(boxes + odd, "id long, plan_id long, x long, y long, w long, h long")
    nearby = graph._merged_nearby(df, ["plan_id"])
    got = {tuple(r) for r in graph.merge_rectangles(df, ["plan_id"]).select("id", "plan_id", *"xywh").collect()}
    assert got == _merged_one_by_one(boxes) | set(odd) and {*odd} <= {tuple(r) for r in nearby.collect()} and len(got) <= nearby.count() < len(boxes + odd)
