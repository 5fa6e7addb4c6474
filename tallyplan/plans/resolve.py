"""Resolvers, page evidence and the smaller operators."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyplan.functions import geometry as G
from tallyplan.functions import text as X
from tallyplan.operators import resolve as R
from tallyplan.operators import spatial as S
from tallyplan.plans.base import D2, INTER, hits, query, table, with_hits
from tallyplan.plans.raster import TEMPLATES, patches
from tallyplan.plans.spatial import _TEXTS, BOX, _on_plans, centres


@query(
    "better_sibling",
    with_hits(f"""SELECT hit_id, sibling FROM (SELECT a.hit_id, b.hit_id AS sibling, row_number() OVER (PARTITION BY a.hit_id ORDER BY b.verif_pct DESC, b.hit_id) AS r FROM hits a JOIN hits b ON a.plan_id = b.plan_id AND a.hit_id <> b.hit_id
 WHERE a.template_id BETWEEN 5 AND 12 AND b.template_id BETWEEN 5 AND 12 AND {INTER} > 0 AND {INTER} * 100 >= least(a.w*a.h, b.w*b.h) * 30 AND b.verif_pct > a.verif_pct + 12) WHERE r = 1"""),
)
def better_sibling(spark, d):
    """Members of a family that a better member of their place replaces."""
    boxes = hits(spark, d).select(*BOX, "template_id", "verif_pct")
    return R.better_sibling(boxes, F.col("template_id").between(5, 12), ["plan_id"], "hit_id", "verif_pct", 12, 30)


@query(
    "promoted_parents",
    with_hits(f"""SELECT child, parent FROM (SELECT a.hit_id AS child, b.hit_id AS parent, row_number() OVER (PARTITION BY a.hit_id ORDER BY {D2}, b.hit_id) AS r FROM hits a JOIN hits b ON a.plan_id = b.plan_id
 WHERE a.template_id IN (6, 9) AND b.template_id IN (7, 10, 12) AND a.x >= b.x - 8 AND a.y >= b.y - 8 AND a.x + a.w <= b.x + b.w + 8 AND a.y + a.h <= b.y + b.h + 8) WHERE r = 1"""),
)
def promoted_parents(spark, d):
    """Parts of a symbol that a larger symbol's frame holds within eight pixels."""
    boxes = hits(spark, d).select(*BOX, "template_id")
    return R.promote(boxes.where("template_id in (6, 9)"), boxes.where("template_id in (7, 10, 12)"), ["plan_id"], "hit_id", 8)


@query("fair_peaks")
def fair_peaks(spark, d):
    """Twelve peaks of each plan and template, apart from one another where there are enough."""
    boxes = hits(spark, d).select(F.col("hit_id").alias("id"), F.struct(-F.col("match_pct"), "y", "x", "hit_id").alias("rank"), "plan_id", "template_id", "x", "y", F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("h"))
    return R.fair_peaks(boxes, ["plan_id", "template_id"], 12, 24).select("plan_id", "template_id", F.col("id").alias("hit_id"))


@query("nearby_boxes", with_hits("SELECT a.hit_id AS a, b.hit_id AS b FROM hits a JOIN hits b ON a.plan_id = b.plan_id AND a.hit_id < b.hit_id AND a.template_id = b.template_id WHERE abs(2*a.x + a.w - 2*b.x - b.w) <= 160 AND abs(2*a.y + a.h - 2*b.y - b.h) <= 160"))
def nearby_boxes(spark, d):
    """Pairs of one symbol within eighty pixels on both axes."""
    points = centres(hits(spark, d), "hit_id", "template_id")
    return S.spatial_join(points, points, lambda a, b: F.col("hit_id_a") < F.col("hit_id_b"), ["plan_id", "template_id"], cell=2048, pad=160).select(F.col("hit_id_a").alias("a"), F.col("hit_id_b").alias("b"))


@query(
    "variants_in_regions",
    with_hits(""", v AS (SELECT plan_id, template_id, line, max(w) AS vw, max(h) AS vh FROM hits GROUP BY plan_id, template_id, line), r AS (SELECT hit_id, plan_id, template_id, w + 12 AS rw, h + 6 AS rh, w * h AS ink FROM hits)
 SELECT hit_id, v.line FROM v JOIN r USING (plan_id, template_id) WHERE vw <= rw AND vh <= rh AND 2 * ink >= vw * vh"""),
)
def variants_in_regions(spark, d):
    """Variants of a plan's templates that fit a search region with enough ink for them."""
    h = hits(spark, d)
    v = h.groupBy("plan_id", "template_id", "line").agg(F.max("w").alias("vw"), F.max("h").alias("vh"))
    r = h.select("hit_id", "plan_id", "template_id", (F.col("w") + 12).alias("rw"), (F.col("h") + 6).alias("rh"), (F.col("w") * F.col("h")).alias("ink"))
    return v.join(r, ["plan_id", "template_id"]).where("vw <= rw and vh <= rh and 2 * ink >= vw * vh").select("hit_id", "line")


@query(
    "layer_matching",
    """WITH a AS (SELECT DISTINCT lower(trim(p_type)) AS k FROM part), q AS (SELECT k FROM (VALUES ('promo brushed'), ('no such layer'), ('standard'), ('economy')) t(k)) SELECT q.k AS layer, a.k IS NOT NULL AS matched FROM q LEFT JOIN a ON q.k = a.k""",
)
def layer_matching(spark, d):
    """Requested layers, matched to available ones by their normal name."""
    have = table(spark, d, "part").select(X.label_key(F.col("p_type")).alias("k")).distinct().withColumn("there", F.lit(True))
    want = spark.createDataFrame([("Promo  Brushed",), ("no such layer",), (" STANDARD",), ("economy",)], "layer string").select(X.label_key(F.col("layer")).alias("k"))
    return want.join(have, "k", "left").select(F.col("k").alias("layer"), F.col("there").isNotNull().alias("matched"))


@query(
    "page_profile",
    "SELECT source, CASE WHEN count(*) < 3 THEN 'too_few' WHEN avg(n_chars) > 4000 THEN 'dense_text' WHEN count(*) FILTER (WHERE lang = 'en') * 2 > count(*) THEN 'vector' ELSE 'raster' END AS profile, count(*) AS blocks FROM documents GROUP BY source",
)
def page_profile(spark, d):
    """A page's kind by ordered rules over its counts, with the first that fits."""
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("blocks"), F.avg("n_chars").alias("mean"), F.count_if(F.col("lang") == "en").alias("en"))
    profile = F.when(F.col("blocks") < 3, "too_few").when(F.col("mean") > 4000, "dense_text").when(F.col("en") * 2 > F.col("blocks"), "vector").otherwise("raster")
    return g.select("source", profile.alias("profile"), "blocks")


@query(
    "legend_exclusion",
    with_hits(f", {_TEXTS} SELECT plan_id, CASE WHEN count(*) FILTER (WHERE x > 900) >= 12 THEN 'right' WHEN count(*) FILTER (WHERE y > 900) >= 10 THEN 'bottom' ELSE 'none' END AS side, count(*) FILTER (WHERE x > 900) AS on_right, min(x) FILTER (WHERE x > 900) AS left_edge FROM texts GROUP BY plan_id"),
)
def legend_exclusion(spark, d):
    """Where a plan's legend is: many words in the right band, else in the bottom one."""
    g = _on_plans(spark, d).groupBy("plan_id").agg(F.count_if(F.col("x") > 900).alias("on_right"), F.count_if(F.col("y") > 900).alias("low"), F.min(F.when(F.col("x") > 900, F.col("x"))).alias("left_edge"))
    return g.select("plan_id", F.when(F.col("on_right") >= 12, "right").when(F.col("low") >= 10, "bottom").otherwise("none").alias("side"), "on_right", "left_edge")


@query(
    "descriptive_text",
    with_hits(f", {_TEXTS} SELECT word_id, x - 4 AS x, y - 4 AS y, w + 8 AS w, h + 8 AS h FROM texts WHERE length(token) >= 9 AND w >= 5 * h"),
)
def descriptive_text(spark, d):
    """Text that describes rather than names: long and flat, with a pad."""
    pad = G.Box().expanded(4)
    return _on_plans(spark, d).where("length(token) >= 9 and w >= 5 * h").select("word_id", pad.x.alias("x"), pad.y.alias("y"), pad.w.alias("w"), pad.h.alias("h"))


@query(
    "continuation_lines",
    """WITH l AS (SELECT p_partkey, p_brand, p_name, CASE WHEN lag(p_size) OVER w > 25 THEN 0 ELSE 1 END AS opens FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)), g AS (SELECT *, sum(opens) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS k FROM l)
 SELECT p_brand, CAST(k AS BIGINT) AS k, string_agg(p_name, ' ' ORDER BY p_partkey) AS label FROM g GROUP BY p_brand, k""",
)
def continuation_lines(spark, d):
    """Lines that continue the one before become one label, in order."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    opens = F.when(F.lag("p_size").over(w) > 25, 0).otherwise(1)
    rows = table(spark, d, "part").withColumn("opens", opens).withColumn("k", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("p_brand", F.col("k").cast("long").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"]), " ").alias("label"))


_GLYPHS = " UNION ALL ".join(f"SELECT {i} AS g, {t} AS t" for i, t in TEMPLATES)


@query(
    "glyph_classes",
    f"""WITH px AS (SELECT vec_id, k, CASE WHEN v > 0.05 THEN 1.0 ELSE 0.0 END AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings)), gp AS (SELECT g, unnest(t) AS v, generate_subscripts(t, 1) AS k FROM ({_GLYPHS})),
 s AS (SELECT vec_id, g, CAST(sum(CAST(abs(px.v - gp.v) AS BIGINT)) AS BIGINT) AS diff FROM px JOIN gp USING (k) GROUP BY vec_id, g) SELECT vec_id, CASE WHEN diff * 100 <= 64 * 45 THEN g END AS glyph, diff FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY diff, g) AS r FROM s) WHERE r = 1""",
)
def glyph_classes(spark, d):
    """The glyph with least mean difference; too far from all is none."""
    table_ = F.array(*(F.struct(F.lit(i).alias("g"), F.array(*(F.lit(int(v)) for v in t)).alias("t")) for i, t in TEMPLATES))
    ink = F.transform("patch", lambda v: (v > 0.05).cast("int"))
    diff = lambda t: F.aggregate(F.zip_with(ink, t, lambda a, b: F.abs(a - b)), F.lit(0), lambda s, v: s + v)
    best = F.array_min(F.transform(table_, lambda t: F.struct(diff(t["t"]).alias("diff"), t["g"].alias("g"))))
    return patches(spark, d).select("vec_id", best.alias("b")).select("vec_id", F.when(F.col("b.diff") * 100 <= 64 * 45, F.col("b.g")).alias("glyph"), F.col("b.diff").cast("long").alias("diff"))


@query("name_colors", "SELECT DISTINCT p_brand, list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(ascii(c) AS BIGINT) FOR c IN string_split(p_brand, '')]), lambda h, c: (h * 31 + c) & 4294967295) AS hash FROM part")
def name_colors(spark, d):
    return table(spark, d, "part").select("p_brand", X.name_color(F.col("p_brand")).alias("hash")).distinct()


@query("pixel_transforms", "SELECT CAST(p_partkey AS BIGINT) AS k, CAST(floor((p_retailprice - 10) * 300 / 72.0 + 0.5) AS BIGINT) AS px FROM part")
def pixel_transforms(spark, d):
    """Points as pixels at 300 dots per inch."""
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), G.points_to_pixels(F.col("p_retailprice"), 300, 10).cast("long").alias("px"))


@query("axis_overlap", with_hits("SELECT a.hit_id AS a, b.hit_id AS b, CAST(greatest(0, greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h)) AS BIGINT) AS gap FROM hits a JOIN hits b ON a.plan_id = b.plan_id AND a.template_id = b.template_id AND a.hit_id < b.hit_id WHERE greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * 2 >= least(a.w, b.w) AND abs(a.y - b.y) <= 60"))
def axis_overlap(spark, d):
    """Boxes above one another: half their width is shared; the gap between them."""
    boxes = hits(spark, d).select(*BOX, "template_id")
    a, b = G.Box("_a"), G.Box("_b")
    above = lambda p, q: (F.col("hit_id_a") < F.col("hit_id_b")) & (G.overlap_1d(p.x, p.w, q.x, q.w) >= 0.5) & (F.abs(p.y - q.y) <= 60)
    return S.spatial_join(boxes, boxes, above, ["plan_id", "template_id"], pad=(0, 60)).select(F.col("hit_id_a").alias("a"), F.col("hit_id_b").alias("b"), G.gap_1d(a.y, a.h, b.y, b.h).cast("long").alias("gap"))


@query("draft_gate", "SELECT source, count(*) >= 2 AND avg(n_chars % 100) >= 45 AS accepted FROM documents GROUP BY source")
def draft_gate(spark, d):
    """Enough drafts, of enough confidence on average."""
    return table(spark, d, "documents").groupBy("source").agg(((F.count("*") >= 2) & (F.avg(F.col("n_chars") % 100) >= 45)).alias("accepted"))


@query("best_by_code", with_hits("SELECT plan_id, template_id, arg_max(hit_id, struct_pack(v := verif_pct, m := match_pct, i := hit_id)) AS hit_id FROM hits GROUP BY plan_id, template_id"))
def best_by_code(spark, d):
    return hits(spark, d).groupBy("plan_id", "template_id").agg(F.max_by("hit_id", F.struct("verif_pct", "match_pct", "hit_id")).alias("hit_id"))


@query(
    "case_boxes",
    with_hits(f""", c AS (SELECT n_nationkey AS case_id, CAST(s_suppkey AS BIGINT) AS plan_id, CAST(n_nationkey * 45 AS BIGINT) AS x, CAST(n_nationkey * 31 % 1000 AS BIGINT) AS y, CAST(80 AS BIGINT) AS w, CAST(60 AS BIGINT) AS h FROM nation JOIN supplier ON s_nationkey = n_nationkey)
 SELECT c.case_id, c.plan_id, a.hit_id FROM c JOIN hits a USING (plan_id) WHERE {INTER.replace('b.', 'c.')} * 100 >= least(a.w*a.h, c.w*c.h) * 20 AND {INTER.replace('b.', 'c.')} > 0"""),
)
def case_boxes(spark, d):
    """Boxes in the regions of review cases, one on each plan: a fifth of the smaller is shared."""
    k = F.col("s_nationkey")
    cases = table(spark, d, "supplier").select(k.alias("case_id"), F.col("s_suppkey").cast("long").alias("plan_id"), (k * 45).cast("long").alias("x"), (k * 31 % 1000).cast("long").alias("y"), F.lit(80).cast("long").alias("w"), F.lit(60).cast("long").alias("h"))
    shared = lambda a, b: (G.intersection(a, b) > 0) & (G.intersection(a, b) * 100 >= F.least(a.area, b.area) * 20)
    return S.spatial_join(cases, hits(spark, d).select(*BOX), shared, ["plan_id"]).select(F.col("case_id_a").alias("case_id"), "plan_id", F.col("hit_id_b").alias("hit_id"))


@query("export_names", "SELECT DISTINCT concat('takeoff_', regexp_replace(regexp_replace(regexp_replace(p_type, '(.)\\.[^.]*$', '\\1'), '[^\\p{L}\\p{N}_.-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), '.xlsx') AS name FROM part")
def export_names(spark, d):
    return table(spark, d, "part").select(X.export_name(F.col("p_type")).alias("name")).distinct()
