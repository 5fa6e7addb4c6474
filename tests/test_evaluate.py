"""Matching two snapshots of boxes against a plain greedy scan."""

import random

import pytest
from pyspark.sql import functions as F

from tallyplan.operators import evaluate as E
from tallyplan.plans.catalogue import QUERIES

KIND = "box_id string, plan_id long, symbol long, x long, y long, w long, h long"


def snapshots():
    """Crowded boxes around the borders of cells, with ties, in two plans; some have no place, id, plan or symbol."""
    rng = random.Random(5)
    side = lambda k: rng.choice((0, E.CELL, -E.CELL)) + rng.randint(-45, 45)
    golden = [(f"g{k:03}", k % 2, rng.randint(0, 1), side(k), side(k), rng.randint(18, 34), rng.randint(18, 34)) for k in range(160)]
    candidate = [(f"c{k:03}", p, s if rng.random() < 0.9 else 1 - s, x + rng.randint(-9, 9), y + rng.choice((0, 0, 8)), w, h) for k, (_, p, s, x, y, w, h) in enumerate(golden) if k % 8]
    odd = [(None, 0, 0, 0, 0, 20, 20), ("p", None, 0, 0, 0, 20, 20), ("q", 0, None, 0, 0, 20, 20), ("x", 0, 0, None, 0, 20, 20), ("h", 0, 0, 0, 0, 20, None), ("far", 0, 0, 9000, 9000, 20, 20)]
    return golden + [(i and f"g{i}", *r) for i, *r in odd], candidate + [(i and f"c{i}", *r) for i, *r in odd]


def d2(a, b):
    return (2 * a[3] + a[5] - 2 * b[3] - b[5]) ** 2 + (2 * a[4] + a[6] - 2 * b[4] - b[6]) ** 2


def scan(golden, candidate, size=12, distance=18):
    """The least open pair by cost and ids, again and again."""
    whole = lambda r: None not in r
    near = lambda a, b: a[1:3] == b[1:3] and d2(a, b) <= 4 * distance**2 and abs(a[5] - b[5]) <= size and abs(a[6] - b[6]) <= size
    pairs = sorted((d2(a, b), a[0], b[0]) for a in filter(whole, golden) for b in filter(whole, candidate) if near(a, b))
    used_a, used_b, out = set(), set(), []
    for cost, a, b in pairs:
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), out.append((a, b, cost))
    return out, len(pairs)


@pytest.mark.parametrize("cell", [E.CELL, 16])
def test_matching_and_report_equal_the_scan(spark, monkeypatch, cell):
    golden, candidate = snapshots()
    monkeypatch.setattr(E, "CELL", cell)
    pairs, tested = scan(golden, candidate)
    assert tested > len(pairs) + 40
    a, b = spark.createDataFrame(golden, KIND), spark.createDataFrame(candidate, KIND)
    got = E.match_snapshots(a, b, ["plan_id", "symbol"]).select("a", "b", "cost").collect()
    assert sorted(map(tuple, got)) == sorted(pairs)
    cost, taken = {p[0]: p[2] for p in pairs}, {p[1] for p in pairs}
    extra = [r for r in candidate if r[0] not in taken]
    conflict = lambda g: any(None not in (*g[1:], *c[1:]) and g[1] == c[1] and g[2] != c[2] and d2(g, c) <= 4 * 20**2 for c in extra)
    status = lambda g: ("moved" if cost[g[0]] else "matched") if g[0] in cost else "conflict" if conflict(g) else "missing"
    want = [(g[1], g[0], "golden", status(g)) for g in golden] + [(c[1], c[0], "candidate", "extra") for c in extra]
    assert {w[3] for w in want} == {"matched", "moved", "missing", "conflict", "extra"}
    report = E.report(a, b)
    assert sorted(map(str, map(tuple, report.select("plan_id", "box_id", "side", "status").collect()))) == sorted(map(str, want))


@pytest.mark.parametrize(("name", "most"), [("snapshot_match_greedy", (2, 0)), ("snapshot_report", (2, 2)), ("regression_gate", (2, 2))])
def test_snapshots_are_shuffled_once(spark, monkeypatch, name, most):
    """By the join that finds the pairs; judging pairs and finding boxes without one shuffle nothing. Rounds see the pairs in dispute alone."""
    plans, rounds, real, matching = [], [], E.stored, E.graph.greedy_matching
    monkeypatch.setattr(E, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    monkeypatch.setattr(E.graph, "greedy_matching", lambda pairs: rounds.append(pairs.count()) or matching(pairs))
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for c, v in zip(before, ("false", "-1"), strict=True):
            spark.conf.set(c, v)
        rows = QUERIES[name](spark, "/root/testdata/sf0.001").count()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    (plan,), (open_,) = plans, rounds
    assert (plan.count("- Exchange hashpartitioning"), plan.count("ReusedExchange")) == most
    hits = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select(F.count("*")).first()[0]
    assert rows and open_ < hits / 50
