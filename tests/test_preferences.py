"""A chain of preferences against the sequential fold over each place's members."""

import numpy as np
from pyspark.sql import functions as F

from tallyplan.operators import preferences as P
from tallyplan.plans.preferred import winner_chain

STEPS = [
    P.Step("larger", lambda h, w: (h("size") >= w("size") + 3) & (h("score") + 2 >= w("score")), lambda h: [h("size"), h("score")]),
    P.Step("kind", lambda h, w: h("kind") == 1, lambda h: [h("score")], lambda b, w: (w("kind") == 0) & (b("score") + 4 >= w("score"))),
    P.Step("smaller", lambda h, w: h("size") + 5 <= w("size"), lambda h: [-h("size"), h("score")], lambda b, w: w("kind") == 1),
]


def plain(members, order):
    won, why = min(members, key=lambda m: (-m["score"], m["id"])), []
    for name in order:
        others = [m for m in members if m["id"] != won["id"]]
        if name == "larger":
            pool = sorted((m for m in others if m["size"] >= won["size"] + 3 and m["score"] + 2 >= won["score"]), key=lambda m: (-m["size"], -m["score"], m["id"]))
            takes = bool(pool)
        elif name == "kind":
            pool = sorted((m for m in others if m["kind"] == 1), key=lambda m: (-m["score"], m["id"]))
            takes = bool(pool) and won["kind"] == 0 and pool[0]["score"] + 4 >= won["score"]
        else:
            pool = sorted((m for m in others if m["size"] + 5 <= won["size"]), key=lambda m: (m["size"], -m["score"], m["id"]))
            takes = bool(pool) and won["kind"] == 1
        if takes:
            won = pool[0]
            why.append(name)
    return won["id"], ",".join(why)


def test_each_step_sees_what_the_last_one_left(spark):
    rng = np.random.default_rng(9)
    rows = [(k, int(rng.integers(40)), int(rng.integers(12)), int(rng.integers(20)), int(rng.integers(2))) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, place long, score long, size long, kind long")
    results = []
    for steps in (STEPS, STEPS[::-1]):
        got = {r.place: (r.id, r.why) for r in P.winners(df, ["place"], "id", [-F.col("score")], steps).collect()}
        members = [dict(zip(("id", "place", "score", "size", "kind"), r, strict=True)) for r in rows]
        assert got == {p: plain([m for m in members if m["place"] == p], [s.name for s in steps]) for p in {r[1] for r in rows}}
        results.append({p: i for p, (i, _) in got.items()})
    assert results[0] != results[1]  # the order of the steps matters


def test_the_steps_of_places_fire(spark):
    names = {n for r in winner_chain(spark, "/root/testdata/sf0.01").select("why").distinct().collect() for n in r.why.split(",")}
    assert names >= {"fuller_label", "fuller_gray"}
