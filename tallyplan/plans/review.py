"""Resolvers over measured hits: places, parents, labels, families, chains of stages and searches in regions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyplan.functions import geometry as G
from tallyplan.functions.geometry import Box
from tallyplan.operators import rules
from tallyplan.operators import selection as S
from tallyplan.operators.spatial import overlapping, spatial_join
from tallyplan.plans.base import CLUSTERS, D2, INTER, hits, query, table, with_hits
from tallyplan.plans.raster import INK, _INK, _PIXELS, _counts
from tallyplan.plans.rules import measured, with_measured

SHAPE = ["hit_id", "plan_id", "template_id", "x", "y", "w", "h"]
_PLAIN = "((a.gray = b.gray AND {clusters}) OR (a.gray <> b.gray AND {inter} > 0 AND (({inter} * 100 >= (a.w*a.h + b.w*b.h - {inter}) * 55 AND {d2} * 10000 <= least(a.w*a.w + a.h*a.h, b.w*b.w + b.h*b.h) * 4 * 256) OR {inter} * 100 >= least(a.w*a.h, b.w*b.h) * 88)))".format(clusters=CLUSTERS, inter=INTER, d2=D2)


def same_place(a, b):
    """One physical place: looser bounds within a profile, tighter ones between gray and colour."""
    inter, far = G.intersection(a, b), G.distance2_squared(a, b)
    tight = (inter * 100 >= G.union_area(a, b) * 55) & (far * 10_000 <= F.least(a.diagonal_squared, b.diagonal_squared) * 4 * 256)
    nested = inter * 100 >= F.least(a.area, b.area) * 88
    return F.when(F.col("gray_a") == F.col("gray_b"), G.clusters(a, b)).otherwise((inter > 0) & (tight | nested))


@query("same_place_counts", with_measured(f"p AS (SELECT a.hit_id FROM measured a JOIN measured b ON a.plan_id = b.plan_id AND a.hit_id <> b.hit_id WHERE {_PLAIN}) SELECT hit_id, count(*) AS n FROM p GROUP BY hit_id"))
def same_place_counts(spark, d):
    """How many other hits share a hit's physical place."""
    boxes = measured(spark, d).select(*SHAPE, "gray")
    other = lambda a, b: (F.col("hit_id_a") != F.col("hit_id_b")) & same_place(a, b)
    return spatial_join(boxes, boxes, other, ["plan_id"]).groupBy(F.col("hit_id_a").alias("hit_id")).agg(F.count("*").alias("n"))


@query("local_candidates", with_hits(f"SELECT a.hit_id, count(*) AS n FROM hits a JOIN hits b ON a.plan_id = b.plan_id AND a.hit_id <> b.hit_id AND b.template_id BETWEEN 5 AND 12 WHERE a.template_id BETWEEN 5 AND 12 AND ({INTER} * 100 >= least(a.w*a.h, b.w*b.h) * 24 OR {D2} <= 4 * greatest(28, 0.4 * greatest(a.w, a.h)) * greatest(28, 0.4 * greatest(a.w, a.h))) GROUP BY a.hit_id"))
def local_candidates(spark, d):
    """Family members near a hit: sharing a quarter of the smaller box, or within 28 pixels or .4 of its side."""
    boxes = hits(spark, d).where("template_id between 5 and 12").select(*SHAPE)

    def near(a, b):
        reach = F.greatest(F.lit(28.0), 0.4 * F.greatest(a.w, a.h))
        return (F.col("hit_id_a") != F.col("hit_id_b")) & ((G.intersection(a, b) * 100 >= F.least(a.area, b.area) * 24) | (G.distance2_squared(a, b) <= 4 * reach * reach))

    return spatial_join(boxes, boxes, near, ["plan_id"], pad=28).groupBy(F.col("hit_id_a").alias("hit_id")).agg(F.count("*").alias("n"))


@query(
    "nested_cores",
    with_measured(f"""small AS (SELECT * FROM measured WHERE area < 900), large AS (SELECT * FROM measured WHERE area >= 1100), lost AS (SELECT DISTINCT a.hit_id FROM small a JOIN large b ON a.plan_id = b.plan_id WHERE {INTER} * 100 >= a.area * 80 AND b.verif + 8 >= a.verif),
 kept AS (SELECT * FROM small WHERE hit_id NOT IN (SELECT hit_id FROM lost)), beaten AS (SELECT DISTINCT b.hit_id FROM kept a JOIN large b ON a.plan_id = b.plan_id WHERE {INTER} * 100 >= a.area * 80 AND a.verif > b.verif + 20)
 SELECT hit_id, 'core' AS why FROM lost UNION ALL SELECT hit_id, 'frame' AS why FROM beaten"""),
)
def nested_cores(spark, d):
    """Small hits that a large one explains go; then large ones that a much better small one, still there, stands in."""
    m = measured(spark, d).select(*SHAPE, "area", "verif")
    small, large = m.where("area < 900"), m.where("area >= 1100")
    inside = G.intersection(Box("_a"), Box("_b")) * 100 >= F.col("area_a") * 80
    pairs = spatial_join(small, large, lambda a, b: (G.intersection(a, b) > 0) & inside, ["plan_id"])
    lost = pairs.where("verif_b + 8 >= verif_a").select(F.col("hit_id_a").alias("hit_id")).distinct()
    left = pairs.join(lost.withColumnRenamed("hit_id", "hit_id_a"), "hit_id_a", "left_anti")
    beaten = left.where("verif_a > verif_b + 20").select(F.col("hit_id_b").alias("hit_id")).distinct()
    return lost.withColumn("why", F.lit("core")).unionByName(beaten.withColumn("why", F.lit("frame")))


@query(
    "label_targets",
    with_measured(f"""t AS (SELECT * FROM measured WHERE text = 1 AND content >= 90), v AS (SELECT * FROM measured WHERE text = 0), r AS (SELECT a.hit_id, b.hit_id AS target, row_number() OVER (PARTITION BY a.hit_id ORDER BY CASE WHEN a.template_id % 5 = b.template_id % 5 THEN 0 ELSE 1 END, CASE WHEN abs(a.color - b.color) <= 9 THEN 0 ELSE 1 END, {D2}, b.hit_id) AS k FROM t a JOIN v b ON a.plan_id = b.plan_id WHERE {D2} <= 4 * 60 * 60)
 SELECT hit_id, target FROM r WHERE k = 1"""),
)
def label_targets(spark, d):
    """A label's symbol: of its family, then of its hue, then the nearest within sixty pixels."""
    m = measured(spark, d).select(*SHAPE, "color", "text", "content")
    pairs = spatial_join(m.where("text = 1 and content >= 90"), m.where("text = 0"), lambda a, b: G.distance2_squared(a, b) <= 4 * 60 * 60, ["plan_id"], cell=128, pad=60)
    family = F.when(F.col("template_id_a") % 5 == F.col("template_id_b") % 5, 0).otherwise(1)
    hue = F.when(F.abs(F.col("color_a") - F.col("color_b")) <= 9, 0).otherwise(1)
    return pairs.groupBy(F.col("hit_id_a").alias("hit_id")).agg(F.min_by("hit_id_b", F.struct(family, hue, G.distance2_squared(Box("_a"), Box("_b")), "hit_id_b")).alias("target"))


@query("gray_alternatives")
def gray_alternatives(spark, d):
    """One reading of the same gray ink: of nearly equal boxes the one of the better score stays, whichever comes first."""
    m = measured(spark, d).where("gray = 1")
    score = (F.col("verif") + F.col("match") + F.col("context")) * 10 + F.col("purity") * 7
    boxes = m.select(F.col("hit_id").alias("id"), F.struct(-score, "y", "x", "hit_id").alias("rank"), "plan_id", "x", "y", "w", "h")

    def same(a, b):
        inter = G.intersection(a, b)
        close = (inter * 100 >= G.union_area(a, b) * 88) & (inter * 100 >= F.least(a.area, b.area) * 94)
        even = (F.greatest(a.w, b.w) * 100 <= F.least(a.w, b.w) * 115) & (F.greatest(a.h, b.h) * 100 <= F.least(a.h, b.h) * 115)
        return (inter > 0) & close & even

    return S.ordered_scan(boxes, S.earlier_pairs(boxes, same, ["plan_id"]).select("first", "id"), F.count("*") > 0).select(F.col("id").alias("hit_id"))


@query("sockets_deduped")
def sockets_deduped(spark, d):
    """Sockets of one place once: those with evidence of text first, then the better ones."""
    m = measured(spark, d).where("template_id between 5 and 12")
    boxes = m.select(F.col("hit_id").alias("id"), F.struct(-F.col("text"), -F.col("verif"), -F.col("match"), "y", "x", "hit_id").alias("rank"), "plan_id", "x", "y", "w", "h")
    same = lambda a, b: (G.intersection(a, b) > 0) & (G.intersection(a, b) * 100 >= F.least(a.area, b.area) * 45)
    return S.ordered_scan(boxes, S.earlier_pairs(boxes, same, ["plan_id"]).select("first", "id"), F.count("*") > 0).select(F.col("id").alias("hit_id"))


@query(
    "parent_search",
    with_measured(f"""r AS (SELECT a.hit_id AS child, b.hit_id AS parent, row_number() OVER (PARTITION BY a.hit_id ORDER BY b.verif DESC, {D2}, b.hit_id) AS k FROM measured a JOIN measured b ON a.plan_id = b.plan_id AND b.template_id = CASE a.template_id WHEN 6 THEN 7 WHEN 9 THEN 7 ELSE 10 END
 WHERE a.template_id IN (6, 9, 11) AND {D2} <= 4 * CASE WHEN a.gray = 1 THEN 18 * 18 ELSE 8 * 8 END AND b.verif + 16 >= a.verif) SELECT child, parent FROM r WHERE k = 1"""),
)
def parent_search(spark, d):
    """A part's parent within 18 pixels, or 8 in colour: the best verified one that isn't much worse than the part."""
    m = measured(spark, d).select(*SHAPE, "gray", "verif")
    wanted = F.when(F.col("template_id").isin(6, 9), 7).otherwise(10)
    children = m.where("template_id in (6, 9, 11)").withColumn("template_id", wanted.cast("long"))

    def near(a, b):
        reach = F.when(F.col("gray_a") == 1, 18 * 18).otherwise(8 * 8)
        return (G.distance2_squared(a, b) <= 4 * reach) & (F.col("verif_b") + 16 >= F.col("verif_a"))

    pairs = spatial_join(children, m.where("template_id in (7, 10)"), near, ["plan_id", "template_id"], pad=18)
    return pairs.groupBy(F.col("hit_id_a").alias("child")).agg(F.min_by("hit_id_b", F.struct(-F.col("verif_b"), G.distance2_squared(Box("_a"), Box("_b")), "hit_id_b")).alias("parent"))


#: Stages of colour hits, in order: what each lets through.
CHAIN = [("sources", "source <> 5"), ("similarity", "color >= 68"), ("match", "match >= 55"), ("coverage", "coverage >= 60 or text = 1"), ("purity", "purity >= 50"), ("context", "context >= 16 or content >= 80")]


@query("color_chain", with_measured("c AS (SELECT plan_id, source <> 5 AS a, color >= 68 AS b, match >= 55 AS c, coverage >= 60 OR text = 1 AS d, purity >= 50 AS e, context >= 16 OR content >= 80 AS f FROM measured WHERE gray = 0) SELECT plan_id, count(*) FILTER (WHERE a) AS sources, count(*) FILTER (WHERE a AND b) AS similarity, count(*) FILTER (WHERE a AND b AND c) AS match, count(*) FILTER (WHERE a AND b AND c AND d) AS coverage, count(*) FILTER (WHERE a AND b AND c AND d AND e) AS purity, count(*) FILTER (WHERE a AND b AND c AND d AND e AND f) AS context FROM c GROUP BY plan_id"))
def color_chain(spark, d):
    """How many colour hits each stage of the chain leaves, in one pass."""
    through, counts = F.lit(True), []
    for name, rule in CHAIN:
        through = through & F.expr(rule)
        counts.append(F.count_if(through).alias(name))
    return measured(spark, d).where("gray = 0").groupBy("plan_id").agg(*counts)


@query(
    "panel_relabels",
    with_measured(f"""t AS (SELECT * FROM measured WHERE text = 1 AND template_id = 14), r AS (SELECT a.hit_id, min(b.hit_id) AS label FROM measured a JOIN t b ON a.plan_id = b.plan_id WHERE a.template_id = 13 AND {D2} <= 4 * 80 * 80 GROUP BY a.hit_id)
 SELECT m.hit_id, CASE WHEN r.label IS NOT NULL THEN 'floor_box' ELSE 'panel' END AS name FROM measured m LEFT JOIN r USING (hit_id) WHERE m.template_id = 13"""),
)
def panel_relabels(spark, d):
    """Panels with a floor label nearby are floor boxes."""
    m = measured(spark, d).select(*SHAPE, "text")
    panels = m.where("template_id = 13").drop("text")
    near = spatial_join(panels, m.where("text = 1 and template_id = 14").drop("text"), lambda a, b: G.distance2_squared(a, b) <= 4 * 80 * 80, ["plan_id"], cell=128, pad=80)
    found = near.select(F.col("hit_id_a").alias("hit_id")).distinct().withColumn("met", F.lit(True))
    return panels.join(found, "hit_id", "left").select("hit_id", F.when(F.col("met"), "floor_box").otherwise("panel").alias("name"))


@query("grid_cells")
def grid_cells(spark, d):
    """Candidate cells of table grids: of nested ones the larger stays."""
    boxes = hits(spark, d).where("template_id between 15 and 22").select(F.col("hit_id").alias("id"), "plan_id", "x", "y", (F.col("w") * (1 + F.col("line"))).alias("w"), "h")
    boxes = boxes.withColumn("rank", F.struct(-(F.col("w") * F.col("h")), "y", "x", "id"))
    return S.contained(boxes, ["plan_id"], 80).select(F.col("id").alias("hit_id"))


@query(
    "engine_choices",
    "SELECT source, CASE WHEN chars < 3000 THEN 'raster' WHEN tables * 2 > n THEN 'vector_tables' ELSE 'vector' END AS engine, CASE WHEN chars < 3000 THEN 'too_little_text' WHEN tables * 2 > n THEN 'tables_found' ELSE 'text_found' END AS reason FROM (SELECT source, count(*) AS n, coalesce(sum(length(text)), 0) AS chars, count(*) FILTER (WHERE text LIKE '%|%') AS tables FROM documents GROUP BY source)",
)
def engine_choices(spark, d):
    """Which engine reads a document, by the first attempt that its content allows, and why."""
    g = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.count_if(F.col("text").contains("|")).alias("tables"))
    steps = [(F.col("chars") < 3000, "raster", "too_little_text"), (F.col("tables") * 2 > F.col("n"), "vector_tables", "tables_found"), (F.lit(True), "vector", "text_found")]
    return g.select("source", F.coalesce(*(F.when(c, e) for c, e, _ in steps)).alias("engine"), F.coalesce(*(F.when(c, r) for c, _, r in steps)).alias("reason"))


@query(
    "legend_rows",
    with_hits(""", s AS (SELECT plan_id, y // 60 AS row_no, min(hit_id) AS symbol, count(*) AS symbols FROM hits WHERE x < 200 GROUP BY ALL), t AS (SELECT plan_id, y // 60 AS row_no, string_agg(CAST(template_id AS VARCHAR), ' ' ORDER BY x, hit_id) AS label FROM hits WHERE x BETWEEN 200 AND 400 GROUP BY ALL)
 SELECT plan_id, row_no, symbol, symbols, label FROM s JOIN t USING (plan_id, row_no)"""),
)
def legend_rows(spark, d):
    """Rows of a legend: what stands in the symbol column, and the words of the label column in order."""
    h = hits(spark, d).withColumn("row_no", F.floor(F.col("y") / 60))
    symbols = h.where("x < 200").groupBy("plan_id", "row_no").agg(F.min("hit_id").alias("symbol"), F.count("*").alias("symbols"))
    word = F.struct("x", "hit_id", F.col("template_id").cast("string").alias("word"))
    labels = h.where("x between 200 and 400").groupBy("plan_id", "row_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda w: w["word"]), " ").alias("label"))  # of one row
    return symbols.join(labels, ["plan_id", "row_no"])


@query(
    "inspected_regions",
    with_hits(f""", r AS (SELECT s_suppkey AS plan_id, s_suppkey * 61 % 900 AS x, s_suppkey * 83 % 900 AS y, 300 AS w, 300 AS h FROM supplier) SELECT b.plan_id, count(*) AS n, count(*) FILTER (WHERE a.verif_pct >= 58) AS accepted, max(a.match_pct) AS best FROM hits a JOIN r b USING (plan_id) WHERE {INTER} > 0 GROUP BY b.plan_id"""),
)
def inspected_regions(spark, d):
    """What a scan finds in the region that a person marked on each plan."""
    s = F.col("s_suppkey").cast("long")
    regions = table(spark, d, "supplier").select(s.alias("plan_id"), (s * 61 % 900).alias("x"), (s * 83 % 900).alias("y"), F.lit(300).cast("long").alias("w"), F.lit(300).cast("long").alias("h"))
    pairs = spatial_join(regions, hits(spark, d).select(*SHAPE, "verif_pct", "match_pct"), overlapping, ["plan_id"], cell=128)
    return pairs.groupBy("plan_id").agg(F.count("*").alias("n"), F.count_if(F.col("verif_pct_b") >= 58).alias("accepted"), F.max("match_pct_b").alias("best"))


@query("gray_zones", with_measured("z AS (SELECT plan_id, CASE WHEN ink_share < 30 THEN 'sparse' WHEN ink_share < 80 THEN 'normal' ELSE 'dense' END AS zone, count(*) AS n, CAST(sum(region_area) AS BIGINT) AS area FROM measured WHERE gray = 1 GROUP BY ALL) SELECT * FROM z"))
def gray_zones(spark, d):
    """A plan's gray regions by how much ink they hold."""
    zone = F.when(F.col("ink_share") < 30, "sparse").when(F.col("ink_share") < 80, "normal").otherwise("dense")
    return measured(spark, d).where("gray = 1").groupBy("plan_id", zone.alias("zone")).agg(F.count("*").alias("n"), F.sum("region_area").alias("area"))


@query("clipped_words", "SELECT word_id, greatest(x, 300) AS x, least(x + w, 800) - greatest(x, 300) AS w FROM (SELECT CAST(p_partkey AS BIGINT) AS word_id, p_partkey * 91 % 1200 AS x, p_partkey * 57 % 1200 AS y, length(p_name) * 6 AS w FROM part) WHERE least(x + w, 800) > greatest(x, 300) AND least(y + 12, 900) > greatest(y, 100)")
def clipped_words(spark, d):
    """Words cut to the legend's rectangle."""
    p = F.col("p_partkey").cast("long")
    w = table(spark, d, "part").select(p.alias("word_id"), (p * 91 % 1200).alias("x"), (p * 57 % 1200).alias("y"), (F.length("p_name") * 6).alias("w"))
    left, right = F.greatest(F.col("x"), F.lit(300)), F.least(F.col("x") + F.col("w"), F.lit(800))
    return w.where((right > left) & (F.least(F.col("y") + 12, F.lit(900)) > F.greatest(F.col("y"), F.lit(100)))).select("word_id", left.alias("x"), (right - left).cast("long").alias("w"))


@query("layer_orders", "SELECT page_id, CAST(len(regexp_extract_all(html, '<(h1|p|li)')) AS BIGINT) AS n, array_to_string(list_slice(regexp_extract_all(html, '<(h1|p|li)', 1), 1, 5), ',') AS first FROM pages")
def layer_orders(spark, d):
    """The order of named parts in a catalogue, read by a pattern."""
    found = F.regexp_extract_all("html", F.lit("<(h1|p|li)"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(found).cast("long").alias("n"), F.array_join(F.slice(found, 1, 5), ",").alias("first"))


@query("additive_columns", "SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, CAST(NULL AS VARCHAR) AS profile FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT CAST(c_custkey AS BIGINT), c_name, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def additive_columns(spark, d):
    """Rows of an older schema beside those of a newer one, which has a column more."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("profile"))
    return c.where("id % 2 = 0").drop("profile").unionByName(c.where("id % 2 = 1"), allowMissingColumns=True)


@query("template_edits", "WITH t AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS name, p_size AS op FROM part) SELECT id, CASE WHEN op % 5 = 1 THEN 'renamed ' || name ELSE name END AS name FROM t WHERE op % 5 <> 0 UNION ALL SELECT id + 1000000, name || ' crop' FROM t WHERE op % 5 = 2")
def template_edits(spark, d):
    """Templates renamed, deleted and cropped anew, as one rewrite of their table."""
    t = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") % 5).alias("op"))
    kept = t.where("op <> 0").select("id", F.when(F.col("op") == 1, F.concat(F.lit("renamed "), "name")).otherwise(F.col("name")).alias("name"))
    return kept.unionByName(t.where("op = 2").select((F.col("id") + 1_000_000).alias("id"), F.concat("name", F.lit(" crop")).alias("name")))


@query("painted_exclusions", f"WITH {_PIXELS} SELECT vec_id, count(*) FILTER (WHERE v > {INK} AND NOT (r BETWEEN 2 AND 4 AND c BETWEEN 1 AND 5)) AS left_ FROM px GROUP BY vec_id")
def painted_exclusions(spark, d):
    """Ink that is left once an excluded zone is painted over."""

    def compute(masks):
        masks = masks.copy()
        masks[:, 2:5, 1:6] = False
        return (masks.sum(axis=(1, 2)),)

    return _counts(spark, d, "vec_id long, left_ long", compute)


@query("table_row_quality", f"WITH {_INK}, n AS (SELECT vec_id, count(*) FILTER (WHERE c < 2) AS code, count(*) FILTER (WHERE c = 2) AS sep, count(*) FILTER (WHERE c > 2) AS body FROM ink GROUP BY vec_id) SELECT vec_id, sep >= 4 AS separated, body >= 6 AS filled, CAST(CASE WHEN sep >= 4 THEN 2 ELSE 0 END + CASE WHEN body >= 6 THEN 3 ELSE 0 END + CASE WHEN code BETWEEN 2 AND 10 THEN 1 ELSE 0 END AS BIGINT) AS quality FROM n")
def table_row_quality(spark, d):
    """Whether a table's row has a separator and content, and its quality."""
    from tallyplan.operators import raster as R
    from tallyplan.plans.raster import patches

    def compute(values):
        m = values > INK
        code, sep, body = m[:, :, :2].sum(axis=(1, 2)), m[:, :, 2].sum(axis=1), m[:, :, 3:].sum(axis=(1, 2))
        some = m.any(axis=(1, 2)).nonzero()[0]
        quality = 2 * (sep >= 4) + 3 * (body >= 6) + ((code >= 2) & (code <= 10))
        return some, (sep >= 4)[some], (body >= 6)[some], quality[some]

    return R.patchwise(patches(spark, d), "vec_id long, separated boolean, filled boolean, quality long", compute)


@query("cell_ink", f"WITH {_INK} SELECT vec_id, r // 4 AS tr, c // 4 AS tc, count(*) AS n, min(r) AS top, max(r) AS bottom FROM ink GROUP BY ALL")
def cell_ink(spark, d):
    """Ink of each table cell, and the rows that it spans."""
    from tallyplan.operators import raster as R
    from tallyplan.plans.raster import patches

    ink = R.pixels(patches(spark, d)).where(F.col("v") > INK)
    return ink.groupBy("vec_id", F.floor(F.col("r") / 4).alias("tr"), F.floor(F.col("c") / 4).alias("tc")).agg(F.count("*").alias("n"), F.min("r").alias("top"), F.max("r").alias("bottom"))


@query("ranked_regions", with_measured("r AS (SELECT plan_id, hit_id, row_number() OVER (PARTITION BY plan_id ORDER BY ink_share * region_area DESC, hit_id) AS k, sum(region_area) OVER (PARTITION BY plan_id ORDER BY ink_share * region_area DESC, hit_id ROWS UNBOUNDED PRECEDING) AS spent FROM measured WHERE gray = 1) SELECT plan_id, hit_id, CAST(spent AS BIGINT) AS spent FROM r WHERE spent <= 400000"))
def ranked_regions(spark, d):
    """Regions with most ink first, while a plan's budget of area lasts."""
    w = Window.partitionBy("plan_id").orderBy(F.desc(F.col("ink_share") * F.col("region_area")), "hit_id").rowsBetween(Window.unboundedPreceding, 0)
    return measured(spark, d).where("gray = 1").select("plan_id", "hit_id", F.sum("region_area").over(w).alias("spent")).where("spent <= 400000")


#: Hits that are no ghosts whatever stands around them: those well explained by their context, full labels, compact colour symbols.
EXEMPT = rules.read("""
explained context>=34
full_label gray=1 text=1 scale>=85 area>=1000 aspect>=135 coverage>=88 purity>=34 content>=70 verif>=66 from_template=1 match>=62
full_label gray=1 text=1 scale>=85 area>=1000 aspect>=135 coverage>=88 purity>=34 content>=82 verif>=66 from_content=1 match>=70
compact scanned=1 area>=700 area<=2200 aspect<=185 match>=62 verif>=62 coverage>=70 purity>=72
""")


def _exempt_sql() -> str:
    head, tail = rules.sql(EXEMPT, "measured", "hit_id", "count(n.name) AS exempt").rsplit(" SELECT r.hit_id", 1)
    return f"{head}, exempt AS (SELECT r.hit_id{tail}), small AS (SELECT hit_id, plan_id, template_id, x // 4 AS x, y // 4 AS y, w, h, verif FROM measured)"


@query(
    "ghost_suppression",
    with_measured(f"""{_exempt_sql()}, near AS (SELECT a.hit_id, count(*) AS stronger, count(*) FILTER (WHERE {INTER} > 0) AS overlapping, min(b.x) AS x0, min(b.y) AS y0, max(b.x + b.w) AS x1, max(b.y + b.h) AS y1, any_value(2*a.x + a.w) AS cx, any_value(2*a.y + a.h) AS cy
 FROM small a JOIN exempt e ON e.hit_id = a.hit_id AND e.exempt = 0 JOIN small b ON a.plan_id = b.plan_id AND a.template_id = b.template_id AND a.hit_id <> b.hit_id WHERE b.verif >= a.verif + 8 AND {D2} * 10000 <= 4 * (a.w*a.w + a.h*a.h) * 27225 GROUP BY a.hit_id),
 many AS (SELECT plan_id, template_id FROM small GROUP BY ALL HAVING count(*) >= 4)
 SELECT hit_id FROM near JOIN small USING (hit_id) JOIN many USING (plan_id, template_id) WHERE stronger >= 3 AND overlapping >= 2 AND 100 * cx BETWEEN 200*x0 - 16*(x1 - x0) AND 200*x1 + 16*(x1 - x0) AND 100 * cy BETWEEN 200*y0 - 16*(y1 - y0) AND 200*y1 + 16*(y1 - y0)"""),
)
def ghost_suppression(spark, d):
    """Weak hits of a template with four hits or more on its plan, amid at least three stronger ones of the same template, two of
    them overlapping. Plans are a quarter of their size here, so that hits of one template crowd."""
    m = measured(spark, d).select("*", *(rules.holds(EXEMPT, n).alias(n) for n in rules.names(EXEMPT))).withColumns({c: F.floor(F.col(c) / 4) for c in ("x", "y")})
    side = ["hit_id", "plan_id", "template_id", "x", "y", "w", "h", "verif"]
    many = m.groupBy("plan_id", "template_id").agg(F.count("*").alias("n")).where("n >= 4").select("plan_id", "template_id")
    weak = m.where("not explained and not full_label and not compact").select(*side).join(many, ["plan_id", "template_id"], "left_semi")
    a, b = G.Box("_a"), G.Box("_b")
    near = lambda p, q: (F.col("hit_id_a") != F.col("hit_id_b")) & (F.col("verif_b") >= F.col("verif_a") + 8) & (G.distance2_squared(p, q) * 10_000 <= p.diagonal_squared * 4 * 27_225)
    pairs = spatial_join(weak, m.select(*side), near, ["plan_id", "template_id"], cell=192, pad=96)
    cx, cy = a.center2
    out = pairs.groupBy("hit_id_a", (cx * 100).alias("cx"), (cy * 100).alias("cy")).agg(
        F.count("*").alias("stronger"), F.count_if(G.intersection(a, b) > 0).alias("overlapping"), F.min(b.x * 200).alias("x0"), F.min(b.y * 200).alias("y0"), F.max((b.x + b.w) * 200).alias("x1"), F.max((b.y + b.h) * 200).alias("y1")
    )
    inside = lambda at, low, high: F.col(at).between(F.col(low) - (F.col(high) - F.col(low)) * 8 / 100, F.col(high) + (F.col(high) - F.col(low)) * 8 / 100)
    return out.where((F.col("stronger") >= 3) & (F.col("overlapping") >= 2) & inside("cx", "x0", "x1") & inside("cy", "y0", "y1")).select(F.col("hit_id_a").alias("hit_id"))
