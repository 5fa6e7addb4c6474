"""Snapshot comparison, sentinels and case verdicts. The candidate snapshot is the golden one, shifted and relabelled."""

from pyspark.sql import functions as F

from tallyplan.operators import evaluate as E
from tallyplan.plans.base import D2, hits, query, table, with_hits


def golden(spark, d):
    return hits(spark, d).select(F.col("hit_id").alias("box_id"), "plan_id", F.col("template_id").alias("symbol"), "x", "y", "w", "h")


def candidate(spark, d):
    h = hits(spark, d).where("line <> 3")
    return h.select(F.col("hit_id").alias("box_id"), "plan_id", F.when(F.col("part") % 31 == 0, F.col("template_id") + 1).otherwise(F.col("template_id")).alias("symbol"), (F.col("x") + F.col("part") % 9 - 4).alias("x"), "y", "w", "h")


_SNAPSHOTS = ", g AS (SELECT hit_id AS box_id, plan_id, template_id AS symbol, x, y, w, h FROM hits), c AS (SELECT hit_id AS box_id, plan_id, CASE WHEN part % 31 = 0 THEN template_id + 1 ELSE template_id END AS symbol, x + part % 9 - 4 AS x, y, w, h FROM hits WHERE line <> 3)"


@query("snapshot_pairs", with_hits(f"{_SNAPSHOTS} SELECT a.box_id AS a, b.box_id AS b, CAST({D2} AS BIGINT) AS cost FROM g a JOIN c b ON a.plan_id = b.plan_id AND a.symbol = b.symbol WHERE {D2} <= 4*18*18 AND abs(a.w - b.w) <= 12 AND abs(a.h - b.h) <= 12"))
def snapshot_pairs(spark, d):
    """Boxes of the two snapshots that could be the same."""
    return E.candidate_pairs(golden(spark, d), candidate(spark, d), ["plan_id", "symbol"], 18, 12).select("a", "b", F.col("cost").cast("long").alias("cost"))


@query("snapshot_match_greedy")
def snapshot_match_greedy(spark, d):
    """One-to-one matching, nearest first."""
    return E.match_snapshots(golden(spark, d), candidate(spark, d), ["plan_id", "symbol"]).select("a", "b", "cost")


@query(
    "snapshot_diff_counts",
    with_hits(f"{_SNAPSHOTS} SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.n, 0) AS golden, coalesce(b.n, 0) AS candidate, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM (SELECT symbol, count(*) AS n FROM g GROUP BY symbol) a FULL JOIN (SELECT symbol, count(*) AS n FROM c GROUP BY symbol) b ON a.symbol = b.symbol"),
)
def snapshot_diff_counts(spark, d):
    a = golden(spark, d).groupBy("symbol").agg(F.count("*").alias("golden"))
    b = candidate(spark, d).groupBy("symbol").agg(F.count("*").alias("candidate"))
    out = a.join(b, "symbol", "full").na.fill(0, ["golden", "candidate"])
    return out.withColumn("delta", F.col("candidate") - F.col("golden"))


@query(
    "nearest_class_conflict",
    with_hits(f"{_SNAPSHOTS} SELECT golden_id, candidate_id, symbol FROM (SELECT a.box_id AS golden_id, b.box_id AS candidate_id, b.symbol, row_number() OVER (PARTITION BY a.box_id ORDER BY {D2}, b.box_id) AS r FROM g a JOIN c b ON a.plan_id = b.plan_id AND a.symbol <> b.symbol WHERE {D2} <= 4*20*20) WHERE r = 1"),
)
def nearest_class_conflict(spark, d):
    return E.nearest_conflicts(golden(spark, d), candidate(spark, d), ["plan_id"], 20)


#: A sentinel for each plan and mode; every third asks for a place by a point, the others by a region.
_SENTINELS = """, s AS (SELECT s_suppkey * 4 + m.k AS id, CAST(s_suppkey AS BIGINT) AS plan_id, m.mode, CAST(s_suppkey * 40 % 1000 + m.k * 30 AS BIGINT) AS x, CAST(s_suppkey * 37 % 1000 AS BIGINT) AS y, CAST(120 AS BIGINT) AS w, CAST(90 + m.k AS BIGINT) AS h,
 s_suppkey % 29 AS symbol, (s_suppkey * 3 + m.k) % 29 AS other, s_suppkey % 3 = 0 AS near FROM supplier CROSS JOIN (VALUES (0, 'require_near'), (1, 'forbid'), (2, 'forbid_near'), (3, 'allow_any_near')) m(k, mode))"""


@query(
    "sentinel_eval",
    with_hits(f"""{_SENTINELS}, n AS (SELECT s.id, count(b.hit_id) AS n FROM s LEFT JOIN hits b ON b.plan_id = s.plan_id AND (s.mode = 'allow_any_near' OR b.template_id IN (s.symbol, s.other)) AND b.line <> 7
 AND CASE WHEN s.near THEN (b.x - s.x) * (b.x - s.x) + (b.y - s.y) * (b.y - s.y) <= 60 * 60
 ELSE 2*b.x + b.w BETWEEN 2*s.x - 60 AND 2*(s.x + s.w) + 60 AND 2*b.y + b.h BETWEEN 2*s.y - 60 AND 2*(s.y + s.h) + 60
  OR greatest(0, least(b.x + b.w, s.x + s.w + 30) - greatest(b.x, s.x - 30)) * greatest(0, least(b.y + b.h, s.y + s.h + 30) - greatest(b.y, s.y - 30)) * 100 >= least(b.w * b.h, (s.w + 60) * (s.h + 60)) * 35 END GROUP BY s.id)
 SELECT id, mode, n, CASE WHEN mode LIKE 'forbid%' THEN n = 0 ELSE n BETWEEN 1 AND 999999 END AS ok FROM s JOIN n USING (id)"""),
)
def sentinel_eval(spark, d):
    """Checks of every plan that symbols are, or aren't, at a place: four modes, by region or by point, without one source."""
    k = F.col("s_suppkey").cast("long")
    # The modes of sentinels.
    modes = F.array(*(F.struct(F.lit(i).alias("k"), F.lit(m).alias("mode")) for i, m in enumerate(("require_near", "forbid", "forbid_near", "allow_any_near"))))
    s = table(spark, d, "supplier").select(k.alias("plan_id"), F.explode(modes).alias("m")).select("plan_id", "m.*")
    p = F.col("plan_id")
    s = s.select((p * 4 + F.col("k")).alias("id"), "plan_id", "mode", (p * 40 % 1000 + F.col("k") * 30).alias("x"), (p * 37 % 1000).alias("y"), F.lit(120).cast("long").alias("w"), (90 + F.col("k")).cast("long").alias("h"), F.array(p % 29, (p * 3 + F.col("k")) % 29).alias("symbols"), (p % 3 == 0).alias("near"))
    boxes = hits(spark, d).where("line <> 7").select("hit_id", "plan_id", "template_id", "x", "y", "w", "h")
    counted = E.sentinel_counts(s, boxes, reach=30, radius=60, share_percent=35)
    return counted.select("id", "mode", "n", F.when(F.col("mode").startswith("forbid"), F.col("n") == 0).otherwise(F.col("n").between(1, 999999)).alias("ok"))


@query(
    "case_verdict",
    with_hits("SELECT plan_id AS case_id, CASE WHEN bool_or(template_id = 28 AND verif_pct > 80) THEN 'fail' WHEN bool_or(template_id IN (3, 4)) THEN 'pass' ELSE 'manual_check' END AS verdict FROM hits GROUP BY plan_id"),
)
def case_verdict(spark, d):
    """A forbidden symbol fails a case, an expected one passes it, else a person looks."""
    out = hits(spark, d).groupBy(F.col("plan_id").alias("case_id")).agg(F.bool_or(F.expr("template_id = 28 and verif_pct > 80")).alias("forbidden"), F.bool_or(F.expr("template_id in (3, 4)")).alias("expected"))
    return out.select("case_id", F.when(F.col("forbidden"), "fail").when(F.col("expected"), "pass").otherwise("manual_check").alias("verdict"))


@query(
    "net_changes",
    with_hits(f"{_SNAPSHOTS}, m AS (SELECT plan_id, count(*) AS n FROM g GROUP BY plan_id), k AS (SELECT plan_id, count(*) AS n FROM c GROUP BY plan_id) SELECT plan_id, coalesce(k.n, 0) - m.n AS net FROM m LEFT JOIN k USING (plan_id)"),
)
def net_changes(spark, d):
    """By how many boxes a plan's candidate snapshot differs; says nothing of which."""
    a = golden(spark, d).groupBy("plan_id").agg(F.count("*").alias("g"))
    b = candidate(spark, d).groupBy("plan_id").agg(F.count("*").alias("c"))
    return a.join(b, "plan_id", "left").select("plan_id", (F.coalesce("c", F.lit(0)) - F.col("g")).alias("net"))


@query("regression_gate")
def regression_gate(spark, d):
    """Plans pass if every golden box has its own match, no box is extra and none stands where another symbol should be."""
    return E.gate(golden(spark, d), candidate(spark, d))


@query("snapshot_report")
def snapshot_report(spark, d):
    """Each box of either snapshot: matched, moved, missing, extra, or in conflict with a box of another symbol."""
    return E.report(golden(spark, d), candidate(spark, d))


@query("review_progress", with_hits("SELECT plan_id, count(*) AS total, count(*) FILTER (WHERE verif_pct >= 76) AS accepted, count(*) FILTER (WHERE verif_pct >= 58) AS acceptable FROM hits GROUP BY plan_id"))
def review_progress(spark, d):
    return hits(spark, d).groupBy("plan_id").agg(F.count("*").alias("total"), F.count_if(F.col("verif_pct") >= 76).alias("accepted"), F.count_if(F.col("verif_pct") >= 58).alias("acceptable"))
