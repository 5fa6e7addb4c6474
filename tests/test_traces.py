"""Provenance and histograms against plain models."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyplan.operators import histogram as H
from tallyplan.operators import trace as T
from tallyplan.plans.catalogue import QUERIES


def test_every_lost_hit_names_its_stage(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(rng.integers(10)), int(rng.integers(10))) for k in range(200)]
    hits = spark.createDataFrame(rows, "id long, a long, b long")
    best = lambda df: df.join(df.groupBy("a").agg(F.max("id").alias("id")), ["id", "a"], "left_semi")
    stages = [("even", lambda df: df.where("b % 2 = 0")), ("best", best), ("small", lambda df: df.where("a < 5"))]

    def plain(order):
        left, lost, counts = list(rows), {}, {}
        for name in order:
            if name == "best":
                top = {a: max(r[0] for r in left if r[1] == a) for a in {r[1] for r in left}}
                kept = [r for r in left if top[r[1]] == r[0]]
            else:
                kept = [r for r in left if (r[2] % 2 == 0 if name == "even" else r[1] < 5)]
            lost |= {r[0]: name for r in left if r not in kept}
            left, counts[name] = kept, len(kept)
        return lost, counts

    results = []
    for order in (stages, [stages[1], stages[0], stages[2]]):
        state, counts = T.through(hits, order, "id")
        at = T.lost_at(F.col("bits"), 3)
        got = {r.id: order[r.k][0] for r in state.select("id", at.alias("k")).collect() if r.k is not None}
        assert (got, counts) == plain([n for n, _ in order])
        results.append(got)
    assert results[0] != results[1]  # the order of stages matters


def test_stages_in_place_equal_stages_that_join(spark):
    rng = np.random.default_rng(9)
    rows = [(k, int(rng.integers(6)), int(rng.integers(10)) if k % 7 else None) for k in range(300)]
    hits = spark.createDataFrame(rows, "id long, a long, b long")

    def first(df):
        place = F.row_number().over(Window.partitionBy("a").orderBy("b", "id"))
        return df.withColumn("place", place).where("place <= 3")

    joining = [("some", lambda df: df.where("b > 1")), ("first", first), ("small", lambda df: df.where("a < 4"))]
    in_place = [("some", F.expr("b > 1")), ("first", T.First(["a"], 3, ["b", "id"])), ("small", F.expr("a < 4"))]
    results = []
    for stages in (joining, in_place, [joining[0], in_place[1], joining[2]]):
        state, counts = T.through(hits, stages, "id")
        results.append((sorted((r.id, r.bits) for r in state.collect()), counts))
    assert results[0] == results[1] == results[2]


def test_provenance_joins_no_hits(spark):
    plan = QUERIES["hit_provenance"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Scan ExistingRDD" not in plan and "LogicalRDD" not in plan


def test_regions_join_the_hits_once(spark):
    plan = QUERIES["trace_by_region"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1


def test_percentiles_of_histograms(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), int(v) if v < 250 else None, int(w)) for k, v, w in zip(rng.integers(0, 3, 500), rng.integers(0, 256, 500), rng.integers(0, 9, 500), strict=True)] + [(7, 4, None)]
    df = spark.createDataFrame(rows, "key long, v long, w long")
    one, two = df.where("v % 2 = 0"), df.where("v % 2 = 1 or v is null")
    merged = H.histograms(one, ["key"], ["v", "w"]).unionByName(H.histograms(two, ["key"], ["v", "w"])).groupBy("key", "channel", "value").agg(F.sum("n").alias("n"))
    got = {(r.key, r.channel): (r.total, r.p10, r.half, r.upper) for r in H.percentiles(merged, ["key"], {"p10": 0.1, "half": 0.5, "upper": 0.75}).collect()}
    for c, at in (("v", 1), ("w", 2)):
        for k in {r[0] for r in rows}:
            values = [r[at] for r in rows if r[0] == k and r[at] is not None]
            if values:
                total, *found = got.pop((k, c))
                assert total == len(values) and np.allclose(found, np.percentile(values, [10, 50, 75]))
    assert not got
