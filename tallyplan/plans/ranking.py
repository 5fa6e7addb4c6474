"""Ranking, validation and diagnostics over hits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyplan.functions.geometry import area_bucket
from tallyplan.operators import rank as R
from tallyplan.operators import takeoff as T
from tallyplan.operators.cascade import cascade
from tallyplan.plans.base import hits, query, with_hits

def order():
    return [F.desc("match_pct"), F.desc("verif_pct"), F.col("y"), F.col("x"), F.col("hit_id")]


_ORDER = "match_pct DESC, verif_pct DESC, y, x, hit_id"


@query(
    "dedupe_final_hits",
    with_hits("SELECT hit_id FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, template_id, x // 64, y // 64 ORDER BY verif_pct DESC, match_pct DESC, hit_id) AS r FROM hits) WHERE r = 1"),
)
def dedupe_final_hits(spark, d):
    """One hit, the best, per template and place."""
    placed = hits(spark, d).withColumn("px", F.floor(F.col("x") / 64)).withColumn("py", F.floor(F.col("y") / 64))
    return placed.groupBy("plan_id", "template_id", "px", "py").agg(F.min_by("hit_id", F.struct(-F.col("verif_pct"), -F.col("match_pct"), "hit_id")).alias("hit_id")).select("hit_id")


@query(
    "raw_budget_topk",
    with_hits(f""", v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, template_id, line ORDER BY {_ORDER}) AS a FROM hits) WHERE a <= 6),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, template_id ORDER BY {_ORDER}) AS b FROM v) WHERE b <= 12),
 held AS (SELECT * FROM t WHERE b <= 4), counts AS (SELECT plan_id, count(*) AS n FROM held GROUP BY plan_id),
 rest AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY {_ORDER}) AS c FROM t WHERE b > 4)
 SELECT hit_id FROM held UNION ALL SELECT hit_id FROM rest LEFT JOIN counts USING (plan_id) WHERE c <= 200 - coalesce(n, 0)"""),
)
def raw_budget_topk(spark, d):
    """Limits per variant and template, reserved rows, and a soft limit per plan."""
    return R.budget(hits(spark, d), ["plan_id", "template_id", "line"], ["plan_id", "template_id"], order(), 6, 12, 4, 200, ["plan_id"]).select("hit_id")


@query("peaks_per_variant", with_hits(f"SELECT hit_id FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, template_id ORDER BY {_ORDER}) AS r FROM hits) WHERE r <= 3 OR verif_pct >= 88"))
def peaks_per_variant(spark, d):
    """The three best of each variant, and every hit whose geometry is proved."""
    return R.top_per_group(hits(spark, d), ["plan_id", "template_id"], order(), 3, F.col("verif_pct") >= 88).select("hit_id")


@query(
    "recovery_quota",
    with_hits(f""", r AS (SELECT * FROM (SELECT *, y // 300 AS region, row_number() OVER (PARTITION BY plan_id, template_id, y // 300 ORDER BY {_ORDER}) AS a FROM hits) WHERE a <= 4)
 SELECT hit_id FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, template_id ORDER BY region, {_ORDER}) AS n FROM r) WHERE n <= 10"""),
)
def recovery_quota(spark, d):
    """Four per region of a variant, ten per variant."""
    rows = hits(spark, d).withColumn("region", F.floor(F.col("y") / 300))
    return R.running_quota(rows, ["region"], ["plan_id", "template_id"], order(), 4, 10).select("hit_id")


@query(
    "cell_fair_topk",
    with_hits(f""", c AS (SELECT *, row_number() OVER (PARTITION BY plan_id, x // 200, y // 200 ORDER BY {_ORDER}) AS a FROM hits)
 SELECT hit_id FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY CASE WHEN a <= 2 THEN 0 ELSE 1 END, {_ORDER}) AS r FROM c) WHERE r <= 60"""),
)
def cell_fair_topk(spark, d):
    """Two of each cell come first, then the best of the rest, sixty per plan."""
    cell = Window.partitionBy("plan_id", F.floor(F.col("x") / 200), F.floor(F.col("y") / 200)).orderBy(*order())
    ranked = hits(spark, d).withColumn("late", (F.row_number().over(cell) > 2).cast("int"))
    return R.top_per_group(ranked, ["plan_id"], [F.col("late"), *order()], 60).select("hit_id")


@query(
    "tile_density_topk",
    with_hits("SELECT plan_id, tx, ty, n FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY n DESC, tx, ty) AS r FROM (SELECT plan_id, x // 150 AS tx, y // 150 AS ty, count(*) AS n FROM hits GROUP BY ALL)) WHERE r <= 5"),
)
def tile_density_topk(spark, d):
    """The five densest tiles of each plan."""
    tiles = hits(spark, d).groupBy("plan_id", F.floor(F.col("x") / 150).alias("tx"), F.floor(F.col("y") / 150).alias("ty")).agg(F.count("*").alias("n"))
    return R.top_per_group(tiles, ["plan_id"], [F.desc("n"), F.col("tx"), F.col("ty")], 5)


@query(
    "supplement_cells",
    with_hits(f""", hit AS (SELECT *, x // 100 AS cx, y // 100 AS cy FROM hits), covered AS (SELECT DISTINCT plan_id, cx, cy FROM hit WHERE verif_pct >= 64)
 SELECT hit_id FROM (SELECT h.*, row_number() OVER (PARTITION BY plan_id, cx, cy ORDER BY {_ORDER}) AS r FROM hit h WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.plan_id = h.plan_id AND c.cx = h.cx AND c.cy = h.cy)) WHERE r = 1"""),
)
def supplement_cells(spark, d):
    """One hit for each cell that no good hit covers."""
    placed = hits(spark, d).withColumn("cx", F.floor(F.col("x") / 100)).withColumn("cy", F.floor(F.col("y") / 100))
    covered = placed.where("verif_pct >= 64").select("plan_id", "cx", "cy").distinct()
    return R.top_per_group(placed.join(covered, ["plan_id", "cx", "cy"], "left_anti"), ["plan_id", "cx", "cy"], order(), 1).select("hit_id")


@query("reading_order", with_hits("SELECT hit_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY y, x, verif_pct DESC, hit_id) AS BIGINT) AS place FROM hits"))
def reading_order(spark, d):
    place = F.row_number().over(Window.partitionBy("plan_id").orderBy("y", "x", F.desc("verif_pct"), "hit_id"))
    return hits(spark, d).select("hit_id", place.cast("long").alias("place"))


@query("draw_order_top", with_hits("SELECT hit_id FROM hits ORDER BY w*h DESC, verif_pct, hit_id LIMIT 50"))
def draw_order_top(spark, d):
    """The first fifty boxes to draw: large and doubtful ones first."""
    return hits(spark, d).orderBy(F.desc(F.col("w") * F.col("h")), "verif_pct", "hit_id").limit(50).select("hit_id")


@query("top_variants", with_hits("SELECT template_id, line, count(*) AS n FROM hits GROUP BY ALL ORDER BY n DESC, template_id, line LIMIT 10"))
def top_variants(spark, d):
    return hits(spark, d).groupBy("template_id", "line").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template_id", "line").limit(10)


@query(
    "trace_near_probes",
    with_hits("""SELECT hit_id, d2 FROM (SELECT hit_id, least((2*x + w - 600) * (2*x + w - 600) + (2*y + h - 600) * (2*y + h - 600), (2*x + w - 1600) * (2*x + w - 1600) + (2*y + h - 1000) * (2*y + h - 1000)) AS d2, verif_pct, match_pct FROM hits WHERE template_id IN (3, 7))
 WHERE d2 <= 4 * 150 * 150 ORDER BY d2, verif_pct DESC, match_pct DESC, hit_id LIMIT 40"""),
)
def trace_near_probes(spark, d):
    """Hits of two symbols within 150 pixels of the nearest probe point, forty at most."""
    from tallyplan.functions.text import parsed_points

    far = F.array_min(F.transform(parsed_points(F.lit("300,300; 800:500; x,1")), lambda p: ((F.col("x") * 2 + F.col("w") - p["x"].cast("long") * 2) * (F.col("x") * 2 + F.col("w") - p["x"].cast("long") * 2) + (F.col("y") * 2 + F.col("h") - p["y"].cast("long") * 2) * (F.col("y") * 2 + F.col("h") - p["y"].cast("long") * 2))))
    near = hits(spark, d).where("template_id in (3, 7)").withColumn("d2", far).where(F.col("d2") <= 4 * 150 * 150)
    return near.orderBy("d2", F.desc("verif_pct"), F.desc("match_pct"), "hit_id").limit(40).select("hit_id", "d2")


#: Rules of the cascade, cheap ones first; numbers are percent.
RULES = [
    ("coverage", "w * h < 640"),
    ("purity", "match_pct < 50"),
    ("context_purity", "verif_pct <= 40"),
    ("noisy_partial", "match_pct < 60 and verif_pct < 52 and w < 30"),
    ("sparse_elongated", "w >= 38 and h <= 25 and match_pct < 74"),
    ("small_scale", "w <= 26 and h <= 28 and match_pct < 68"),
    ("tiny_fragment", "greatest(w, h) <= 29 and verif_pct < 64"),
    ("large_scale_partial", "w * h >= 1400 and match_pct < 70 and verif_pct > 76"),
    ("centroid_offset", "(x + y) % 23 = 0 and verif_pct < 70"),
    ("color", "abs(template_id - line * 4) > 22 and match_pct < 80"),
    ("verification", "45 * match_pct + 55 * verif_pct < 6200"),
]
_REASON = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in RULES) + " END"


def validated(spark, d):
    return cascade(hits(spark, d), [(n, F.expr(c)) for n, c in RULES])


@query("validation_cascade_reason", with_hits(f"SELECT hit_id, {_REASON} AS reason FROM hits"))
def validation_cascade_reason(spark, d):
    """The first failing rule of each hit; null if it is accepted."""
    return validated(spark, d).select("hit_id", "reason")


@query(
    "rejection_histogram",
    with_hits(f", r AS (SELECT template_id % 3 AS source, {_REASON} AS reason FROM hits) SELECT source, reason, count(*) AS n, CAST(grouping(source) AS BIGINT) AS level FROM r WHERE reason IS NOT NULL GROUP BY GROUPING SETS ((reason), (source, reason))"),
)
def rejection_histogram(spark, d):
    """Rejections by reason, and by source and reason, in one pass."""
    rows = validated(spark, d).where("reason is not null").withColumn("source", F.col("template_id") % 3)
    out = T.grouped_profile(rows, [["reason"], ["source", "reason"]], {"n": F.count("*")})
    return out.select("source", "reason", "n", F.when(F.col("source").isNull(), 1).otherwise(0).cast("long").alias("level"))


_STAGES = f"s AS (SELECT *, {_REASON} AS reason, row_number() OVER (PARTITION BY plan_id, template_id ORDER BY {_ORDER}) AS r FROM hits)"


@query(
    "stage_funnel",
    with_hits(f", {_STAGES} SELECT template_id, count(*) AS raw, count(*) FILTER (WHERE r <= 8) AS budgeted, count(*) FILTER (WHERE r <= 8 AND reason IS NULL) AS validated, count(*) FILTER (WHERE r <= 3 AND reason IS NULL) AS final, round(CAST(count(*) FILTER (WHERE r <= 3 AND reason IS NULL) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE r <= 8 AND reason IS NULL)), 6) AS yield FROM s GROUP BY template_id"),
)
def stage_funnel(spark, d):
    """Hits of each template after each stage, and the share of the validated that is final."""
    rows = validated(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("plan_id", "template_id").orderBy(*order())))
    stages = F.filter(F.array(F.lit("raw"), F.when(F.col("r") <= 8, "budgeted"), F.when((F.col("r") <= 8) & F.col("reason").isNull(), "validated"), F.when((F.col("r") <= 3) & F.col("reason").isNull(), "final")), lambda s: s.isNotNull())
    wide = rows.select("template_id", F.explode(stages).alias("stage")).groupBy("template_id").pivot("stage", ["raw", "budgeted", "validated", "final"]).count().na.fill(0)
    return wide.withColumn("yield", F.round(F.col("final") / F.greatest(F.lit(1), "validated"), 6))


@query(
    "funnel_totals",
    with_hits(f", {_STAGES} SELECT count(*) AS raw, count(*) FILTER (WHERE r <= 8) AS budgeted, count(*) FILTER (WHERE r > 8) AS removed_by_budget, count(*) FILTER (WHERE r <= 8 AND reason IS NOT NULL) AS removed_by_rules FROM s"),
)
def funnel_totals(spark, d):
    rows = validated(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("plan_id", "template_id").orderBy(*order())))
    return rows.agg(F.count("*").alias("raw"), F.count_if(F.col("r") <= 8).alias("budgeted"), F.count_if(F.col("r") > 8).alias("removed_by_budget"), F.count_if((F.col("r") <= 8) & F.col("reason").isNotNull()).alias("removed_by_rules"))


@query(
    "scan_profile_grouping_sets",
    with_hits("SELECT template_id, line, CAST(grouping(template_id) * 2 + grouping(line) AS BIGINT) AS level, count(*) AS hits, CAST(sum(w * h) AS BIGINT) AS pixels, max(match_pct) AS best FROM hits GROUP BY GROUPING SETS ((template_id), (line), ())"),
)
def scan_profile_grouping_sets(spark, d):
    """The same measures by template, by scale and in total."""
    out = T.grouped_profile(hits(spark, d), [["template_id"], ["line"], []], {"hits": F.count("*"), "pixels": F.sum(F.col("w") * F.col("h")), "best": F.max("match_pct")})
    return out.select("template_id", "line", F.col("level").cast("long").alias("level"), "hits", "pixels", "best")


@query(
    "roi_bucket_profile",
    with_hits("SELECT CASE WHEN a < 10000 THEN '<10k' WHEN a < 50000 THEN '10k-50k' WHEN a < 100000 THEN '50k-100k' WHEN a < 200000 THEN '100k-200k' ELSE '>=200k' END AS bucket, count(*) AS n, CAST(sum(a) AS BIGINT) AS area FROM (SELECT w * h * (1 + template_id * 7) AS a FROM hits) GROUP BY 1"),
)
def roi_bucket_profile(spark, d):
    area = F.col("w") * F.col("h") * (1 + F.col("template_id") * 7)
    return hits(spark, d).select(area.alias("a")).groupBy(area_bucket(F.col("a")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("a").alias("area"))


@query(
    "strategy_profile",
    with_hits("SELECT strategy, template_id, count(*) AS n, round(CAST(count(*) FILTER (WHERE verif_pct >= 64) AS DOUBLE) / greatest(1, count(*)), 6) AS ratio FROM (SELECT *, CASE WHEN w >= 36 THEN 'large' WHEN h <= 27 THEN 'elongated' ELSE 'compact' END AS strategy FROM hits) GROUP BY ROLLUP (strategy, template_id)"),
)
def strategy_profile(spark, d):
    """Counts and yields by strategy, then template within it, by one rollup."""
    rows = hits(spark, d).withColumn("strategy", F.when(F.col("w") >= 36, "large").when(F.col("h") <= 27, "elongated").otherwise("compact"))
    return rows.rollup("strategy", "template_id").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("verif_pct") >= 64) / F.greatest(F.lit(1), F.count("*")), 6).alias("ratio"))


@query("stage_scale_histogram", with_hits(f", {_STAGES} SELECT line AS scale, count(*) AS raw, count(*) FILTER (WHERE r <= 8) AS candidates, count(*) FILTER (WHERE r <= 8 AND reason IS NULL) AS accepted FROM s GROUP BY line"))
def stage_scale_histogram(spark, d):
    rows = validated(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("plan_id", "template_id").orderBy(*order())))
    return rows.groupBy(F.col("line").alias("scale")).agg(F.count("*").alias("raw"), F.count_if(F.col("r") <= 8).alias("candidates"), F.count_if((F.col("r") <= 8) & F.col("reason").isNull()).alias("accepted"))


@query(
    "set_ops_trace",
    with_hits(f", {_STAGES}, a AS (SELECT hit_id FROM s WHERE r <= 8), b AS (SELECT hit_id FROM s WHERE reason IS NULL) SELECT 'suppressed' AS kind, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'restored', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'streams', count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"),
)
def set_ops_trace(spark, d):
    """Suppressed and restored hits by identity, and the unions of two streams."""
    rows = validated(spark, d).withColumn("r", F.row_number().over(Window.partitionBy("plan_id", "template_id").orderBy(*order())))
    a, b = rows.where("r <= 8").select("hit_id"), rows.where("reason is null").select("hit_id")
    kinds = {"suppressed": a.join(b, "hit_id", "left_anti"), "restored": b.join(a, "hit_id", "left_anti"), "either": a.union(b).distinct(), "streams": a.unionByName(b)}
    out = None
    for kind, rows_ in kinds.items():
        one = rows_.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "variants_of_templates",
    """SELECT t.template_id, s.scale, r.rotation, m.mirrored FROM (SELECT DISTINCT CAST(p_partkey % 29 AS BIGINT) AS template_id FROM part) t CROSS JOIN (VALUES (85), (100), (115)) s(scale) CROSS JOIN (VALUES (0), (90), (180), (270)) r(rotation) CROSS JOIN (VALUES (false), (true)) m(mirrored) WHERE (t.template_id % 4 <> 0 OR r.rotation IN (0, 90)) AND (t.template_id % 2 = 1 OR NOT m.mirrored)""",
)
def variants_of_templates(spark, d):
    """Templates times the fixed scales, turns and mirrors; symmetric ones have fewer."""
    templates = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_partkey") % 29).cast("long").alias("template_id")).distinct()
    dims = [("scale", [85, 100, 115]), ("rotation", [0, 90, 180, 270]), ("mirrored", [False, True])]
    for name, values in dims:
        templates = templates.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return templates.where("(template_id % 4 <> 0 or rotation in (0, 90)) and (template_id % 2 = 1 or not mirrored)")
