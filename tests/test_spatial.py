"""Spatial joins against brute force, and how many rows they shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from tallyplan.operators import spatial as S
from tallyplan.plans.catalogue import QUERIES


def _boxes(spark, n, seed):
    rng = random.Random(seed)
    rows = [(k, k % 2, rng.randint(-700, 700), rng.randint(-700, 700), rng.randint(1, 60), rng.randint(1, 60)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "id long, plan_id long, x long, y long, w long, h long")


@pytest.mark.parametrize(("cell", "pad"), [(None, 0), (None, 25), (None, (0, 60)), (None, (70, 5)), (64, (0, 60)), (1024, 25)])
def test_pads_by_axis_equal_brute_force(spark, cell, pad):
    rows, df = _boxes(spark, 120, 5)
    px, py = pad if isinstance(pad, tuple) else (pad, pad)
    apart = lambda a, b, at, size: max(a[at], b[at]) - min(a[at] + a[size], b[at] + b[size])
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and apart(a, b, 2, 4) <= px and apart(a, b, 3, 5) <= py)

    def near(a, b):
        gap = lambda p, ps, q, qs: F.greatest(p, q) - F.least(p + ps, q + qs)
        return (gap(a.x, a.w, b.x, b.w) <= px) & (gap(a.y, a.h, b.y, b.h) <= py)

    got = S.spatial_join(df, df, near, ["plan_id"], cell, pad).select("id_a", "id_b").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("pad", [0, 28, 60, (0, 60), 100])
def test_joins_shuffle_few_rows_a_box(spark, pad):
    _, df = _boxes(spark, 2000, 6)
    plan = S.spatial_join(df, df, S.overlapping, ["plan_id"], pad=pad)
    sides = []
    tree = [plan._jdf.queryExecution().optimizedPlan()]
    while tree:
        node = tree.pop()
        if node.nodeName() == "Join":
            sides = [node.children().apply(0), node.children().apply(1)]
            break
        tree.extend(node.children().apply(k) for k in range(node.children().length()))
    count = lambda p: spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, p).count()
    assert sum(map(count, sides)) < 4.5 * 2000


def test_counts_of_neighbours_join_no_hits_again(spark):
    plan = QUERIES["neighbour_alternatives"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_pairs_are_judged_in_small_methods(spark):
    """Methods of over 8,000 bytes aren't compiled by the JVM, and the judging of pairs in one place is most of the work."""
    import re

    from tallyplan.plans import selection, spatial
    from tallyplan.plans.base import hits

    data = "/root/testdata/sf0.001"
    explain = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    adaptive, limit = (spark.conf.get(f"spark.sql.{c}") for c in ("adaptive.enabled", "autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for threshold in ("-1", limit):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            for df in (spatial.cluster_edges(hits(spark, data)), selection.dominating(selection.by_quality(spark, data).select(*selection.SIDE))):
                sizes = re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(explain))
                assert sizes and max(map(int, sizes)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_finished_components_leave_the_rounds(spark, monkeypatch):
    """A long path among many pairs and triangles, a loop and a doubled edge: rounds after the first hold the path alone."""
    from tallyplan.operators import graph

    rows, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (lambda out: rows.append((out.columns, out.count())) or out)(real(df)))
    path = [(k, k + 1) for k in range(40)]
    small = [(1000 + 2 * k, 1001 + 2 * k) for k in range(300)] + [e for k in range(100) for e in ((5000 + 3 * k, 5001 + 3 * k), (5001 + 3 * k, 5002 + 3 * k), (5002 + 3 * k, 5000 + 3 * k))]
    edges = [*path, *small, (7000, 7000), (7001, 7001), (7001, 7002), (1001, 1000), (40, 39)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{k: 0 for k in range(41)}, **{1000 + k: 1000 + k // 2 * 2 for k in range(600)}, **{5000 + k: 5000 + k // 3 * 3 for k in range(300)}, 7000: 7000, 7001: 7001, 7002: 7001}
    assert got == want
    seen = [n for columns, n in rows if "open" in columns]
    assert max(seen) < 400 and max(seen[1:]) <= 41


def test_a_matching_round_writes_once_and_shuffles_pairs_twice(spark, monkeypatch):
    from tallyplan.operators import evaluate, graph

    plans, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    pairs = spark.range(500).selectExpr("id AS a", "id + 1000 AS b", "id % 7 AS cost", "id % 3 AS plan_id").unionByName(spark.range(500).selectExpr("id AS a", "id + 1001 AS b", "9L AS cost", "id % 3 AS plan_id"))
    got = graph.greedy_matching(pairs.repartition(3))
    assert sorted((r.a, r.b, r.plan_id) for r in got.collect()) == [(k, k + 1000, k % 3) for k in range(500)]
    assert len(plans) == 2 and plans[0].count("Exchange hashpartitioning") == 2
    plans.clear()
    _, boxes = _boxes(spark, 100, 8)
    boxes = boxes.withColumnRenamed("id", "box_id").withColumn("symbol", F.lit(1))
    assert {r.status for r in evaluate.report(boxes, boxes).collect()} == {"matched"} and len(plans) == 3


def test_scans_shuffle_boxes_for_the_join_alone(spark):
    """Copies are told within the cells of the join: no shuffle by place before it, and none of copies by one another."""
    from tallyplan.operators import selection

    pile = spark.range(3000).selectExpr("id", "id AS rank", "id DIV 5000 + 1 AS plan_id", "250L + id DIV 5000 AS x", "id % 2 AS y", "20L AS w", "30L AS h")
    pairs = selection.pairs_without_copies(pile, S.overlapping, ["plan_id"])
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = [(r.first, r.id, r.copy) for r in pairs.select("first", "id", "copy").collect()]
    assert sorted(got) == sorted([(0, 1, False), *((k % 2, k, True) for k in range(2, 3000))])
    assert [r.id for r in selection.contained(pile, ["plan_id"], 80).collect()] == [0]


def test_hits_are_dealt_once_to_the_nearest_text(spark):
    tree = [QUERIES["nearest_text"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan()]
    while (node := tree.pop()).nodeName() != "Join":
        tree.extend(node.children().apply(k) for k in range(node.children().length()))
    dealt = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node.children().apply(1)).count()
    assert dealt == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()


@pytest.mark.parametrize("pad", [0, 30])
def test_summaries_equal_brute_force(spark, pad):
    """Small, large and equal boxes, boxes without a place, a size or a plan, and plans without any other box."""
    rng = random.Random(9)
    size = lambda: rng.choice([0, 1, 40, 127, 128, 129, 300, 900])
    rows = [(k, k % 3, rng.randint(-700, 700), rng.randint(-700, 700), size(), size()) for k in range(150)]
    rows += [rows[3], rows[3], (200, 0, None, 5, 9, 9), (201, 0, 5, 5, None, 900), (202, None, 0, 0, 500, 9), (203, 7, 0, 0, 9, 9), (204, 7, 0, 0, 500, 500)]
    others = [(k, k % 3, rng.randint(-700, 700), rng.randint(-700, 700), size(), size()) for k in range(60)] + [(60, None, 0, 0, 50, 50), (61, 0, 0, None, 50, 50)]
    kind = "id long, plan_id long, x long, y long, w long, h long"
    apart = lambda a, b, at, size: max(a[at], b[at]) - min(a[at] + a[size], b[at] + b[size])
    near = lambda a, b: None not in a and None not in b and a[1] == b[1] and apart(a, b, 2, 4) <= pad and apart(a, b, 3, 5) <= pad
    met = [[b[0] for b in others if near(a, b)] for a in rows]
    gap = lambda p, ps, q, qs: F.greatest(p, q) - F.least(p + ps, q + qs)
    within = lambda a, b: (gap(a.x, a.w, b.x, b.w) <= pad) & (gap(a.y, a.h, b.y, b.h) <= pad)
    sums = [F.count("id_b").alias("n"), F.sum("id_b").alias("sum"), F.count_distinct("h_b").alias("heights")]
    got = S.summarised(spark.createDataFrame(rows, kind), spark.createDataFrame(others, kind), within, ["plan_id"], ["id", "plan_id"], sums, pad)
    assert got.columns == ["id", "plan_id", "n", "sum", "heights"]
    heights = {b[0]: b[5] for b in others}
    want = [(a[0], a[1], len(m), sum(m) if m else None, len({heights[b] for b in m})) for a, m in zip(rows, met, strict=True)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and max(map(len, met)) > 5


@pytest.mark.parametrize("name", ["text_class_hints", "socket_family_resolve"])
def test_hits_with_texts_are_dealt_once(spark, name):
    """Neither copied for the cells of the join nor dealt again to be joined with what was found."""
    data, before = "/root/testdata/sf0.001", {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    hits = spark.read.parquet(f"{data}/lineitem.parquet").where("l_partkey % 29 < 5" if name == "socket_family_resolve" else "true").count()
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = QUERIES[name](spark, data)
        assert df.count() == hits
        tree, dealt = [df._jdf.queryExecution().executedPlan()], 0
        df.collect()
        while tree:
            node = tree.pop()
            if node.nodeName() == "Exchange" and "lineitem.parquet" in node.toString():
                dealt += node.metrics().apply("shuffleRecordsWritten").value()
            tree.extend(node.children().apply(k) for k in range(node.children().length()))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert dealt == hits


@pytest.mark.parametrize("pad", [0, 25, (70, 5)])
def test_pads_between_two_relations_equal_brute_force(spark, pad):
    (some, a), (more, b) = _boxes(spark, 90, 11), _boxes(spark, 130, 12)
    px, py = pad if isinstance(pad, tuple) else (pad, pad)
    apart = lambda a, b, at, size: max(a[at], b[at]) - min(a[at] + a[size], b[at] + b[size])
    want = sorted((p[0], q[0]) for p in some for q in more if p[1] == q[1] and apart(p, q, 2, 4) <= px and apart(p, q, 3, 5) <= py)
    got = S.spatial_join(a, b, lambda p, q: F.lit(True), ["plan_id"], pad=pad).select("id_a", "id_b").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("name", ["nearby_boxes", "neighbour_alternatives", "axis_overlap"])
def test_padded_joins_with_itself_shuffle_one_side(spark, name):
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    join = plan[plan.index("SortMergeJoin") :]
    assert join.count("+- Exchange hashpartitioning(") == 1 and join.count("ReusedExchange") == 1
