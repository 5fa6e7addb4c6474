"""Lookups: labels, template and variant attributes, families, rows and cells, visible projects."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyplan.functions import text as X
from tallyplan.operators import spatial as S
from tallyplan.plans.base import hits, query, table, with_hits
from tallyplan.plans.rules import measured, with_measured


@query(
    "symbol_labels",
    """WITH stored AS (SELECT p_type AS symbol, max(p_name) AS label FROM part WHERE p_size > 10 GROUP BY p_type), asked AS (SELECT p_type AS symbol, max(p_brand) AS label FROM part WHERE p_size > 40 GROUP BY p_type)
 SELECT DISTINCT p.p_type AS symbol, coalesce(a.label, s.label, trim(regexp_replace(replace(lower(p.p_type), '_', ' '), ' +', ' ', 'g'))) AS label FROM part p LEFT JOIN stored s ON s.symbol = p.p_type LEFT JOIN asked a ON a.symbol = p.p_type""",
)
def symbol_labels(spark, d):
    """A symbol's label: a request's own, else the stored one, else the name made readable."""
    part = table(spark, d, "part").select(F.col("p_type").alias("symbol"), "p_name", "p_brand", "p_size")
    maps = part.groupBy("symbol").agg(F.max(F.when(F.col("p_size") > 10, F.col("p_name"))).alias("stored"), F.max(F.when(F.col("p_size") > 40, F.col("p_brand"))).alias("asked"))
    return maps.select("symbol", F.coalesce("asked", "stored", X.pretty_name(F.lower("symbol"))).alias("label"))


@query(
    "label_maps_merged",
    """WITH stored AS (SELECT p_brand AS k, max(p_name) AS v FROM part GROUP BY p_brand), later AS (SELECT p_brand AS k, max(trim(p_type)) AS v FROM part WHERE p_size % 5 = 0 GROUP BY p_brand)
 SELECT k, coalesce(nullif(later.v, ''), stored.v) AS label FROM stored FULL JOIN later USING (k)""",
)
def label_maps_merged(spark, d):
    """Two maps of labels as one: a key's later, non-empty label wins."""
    part = table(spark, d, "part")
    stored = part.groupBy(F.col("p_brand").alias("k")).agg(F.max("p_name").alias("v"))
    later = part.where("p_size % 5 = 0").groupBy(F.col("p_brand").alias("k")).agg(F.max(F.trim("p_type")).alias("v"))
    one = stored.withColumn("turn", F.lit(0)).unionByName(later.where("v <> ''").withColumn("turn", F.lit(1)))
    return one.groupBy("k").agg(F.max_by("v", "turn").alias("label"))


_TEMPLATES = "t AS (SELECT CAST(p_partkey AS BIGINT) AS template_id, p_name AS name, CAST(p_size AS BIGINT) AS pixels FROM part WHERE p_partkey < 25)"


def _templates(spark, d):
    return table(spark, d, "part").where("p_partkey < 25").select(F.col("p_partkey").cast("long").alias("template_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("pixels"))


@query("template_attributes", with_hits(f", {_TEMPLATES} SELECT h.hit_id, coalesce(t.name, 'unknown') AS name, coalesce(t.pixels, 0) AS pixels FROM hits h LEFT JOIN t USING (template_id)"))
def template_attributes(spark, d):
    """Hits with their template's attributes; a number without a template is unknown."""
    joined = hits(spark, d).select("hit_id", "template_id").join(_templates(spark, d), "template_id", "left")
    return joined.select("hit_id", F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("pixels", F.lit(0)).alias("pixels"))


@query(
    "variant_lookup",
    with_measured("v AS (SELECT template_id, scale, rotation, mirrored, max(pixels) AS pixels FROM measured WHERE plan_id % 2 = 0 GROUP BY ALL) SELECT m.hit_id, v.pixels FROM measured m LEFT JOIN v ON v.template_id = m.template_id AND v.scale = m.scale AND v.rotation = m.rotation AND v.mirrored = m.mirrored"),
)
def variant_lookup(spark, d):
    """The variant of a hit by template, scale, rotation and mirroring."""
    m, key = measured(spark, d), ["template_id", "scale", "rotation", "mirrored"]
    variants = m.where("plan_id % 2 = 0").groupBy(*key).agg(F.max("pixels").alias("largest"))
    return m.select("hit_id", *key).join(variants, key, "left").select("hit_id", F.col("largest").alias("pixels"))


# The families' parents, by the two digits that a child's name starts with.
FAMILIES = {"06": ("07",), "09": ("07",), "11": ("10", "12")}


@query(
    "family_parents",
    "WITH n AS (SELECT p_partkey AS id, lpad(CAST(p_partkey % 14 AS VARCHAR), 2, '0') AS code FROM part), f(child, parent) AS (VALUES ('06', '07'), ('09', '07'), ('11', '10'), ('11', '12')) SELECT CAST(id AS BIGINT) AS id, code, string_agg(parent, ',' ORDER BY parent) AS parents FROM n JOIN f ON f.child = n.code GROUP BY id, code",
)
def family_parents(spark, d):
    """Templates whose part of a family may stand in a larger symbol, with that symbol's numbers."""
    n = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.lpad((F.col("p_partkey") % 14).cast("string"), 2, "0").alias("code"))
    parents = F.create_map(*(F.lit(x) for child, over in FAMILIES.items() for x in (child, ",".join(over))))
    return n.select("id", "code", parents[F.col("code")].alias("parents")).where("parents is not null")


@query(
    "component_rows",
    with_hits(""", c AS (SELECT hit_id, plan_id, y + h / 2.0 AS cy FROM hits WHERE template_id < 4), r AS (SELECT DISTINCT plan_id, y // 60 * 60 AS y0, y // 60 * 60 + 40 AS y1 FROM hits WHERE template_id >= 20)
 SELECT hit_id, y0 FROM (SELECT c.hit_id, r.y0, row_number() OVER (PARTITION BY c.hit_id ORDER BY CASE WHEN cy BETWEEN y0 AND y1 THEN 0 ELSE abs(cy - (y0 + y1) / 2.0) END, y0) AS k FROM c JOIN r ON r.plan_id = c.plan_id WHERE cy BETWEEN y0 - 30 AND y1 + 30) WHERE k = 1"""),
)
def component_rows(spark, d):
    """Components to table rows: the one whose band holds the centre, else the nearest within thirty pixels."""
    h = hits(spark, d)
    band = F.floor(F.col("y") / 60) * 60
    rows = h.where("template_id >= 20").select("plan_id", band.alias("y"), F.lit(40).cast("long").alias("h")).distinct().select("plan_id", F.lit(0).cast("long").alias("x"), "y", F.lit(1).cast("long").alias("w"), "h")
    comps = h.where("template_id < 4").select("hit_id", "plan_id", F.lit(0).cast("long").alias("x"), (F.col("y") + F.col("h") / 2.0).alias("y"), F.lit(1).cast("long").alias("w"), F.lit(0).cast("long").alias("h"))
    near = lambda a, b: a.y.between(b.y - 30, b.y + b.h + 30)
    pairs = S.spatial_join(comps, rows, near, ["plan_id"], cell=128, pad=30)
    far = F.when(F.col("y_a").between(F.col("y_b"), F.col("y_b") + F.col("h_b")), 0.0).otherwise(F.abs(F.col("y_a") - (2 * F.col("y_b") + F.col("h_b")) / 2.0))
    return pairs.groupBy(F.col("hit_id_a").alias("hit_id")).agg(F.min(F.struct(far, "y_b")).alias("best")).select("hit_id", F.col("best.y_b").alias("y0"))


@query(
    "text_cells",
    """WITH w AS (SELECT CAST(p_partkey AS BIGINT) AS word_id, p_partkey * 57 % 1200 AS y, p_partkey * 91 % 1200 AS x FROM part) SELECT word_id, CAST((y + 6) // 40 AS BIGINT) AS row_no, CASE WHEN x < 144 THEN 'code' WHEN x < 700 THEN 'label' ELSE 'count' END AS cell FROM w WHERE least(y + 12, (y + 6) // 40 * 40 + 40) - greatest(y, (y + 6) // 40 * 40) >= 8""",
)
def text_cells(spark, d):
    """Words to table cells: two thirds of a word's height in the row's band, and the column band of its start."""
    p = F.col("p_partkey").cast("long")
    w = table(spark, d, "part").select(p.alias("word_id"), (p * 57 % 1200).alias("y"), (p * 91 % 1200).alias("x")).withColumn("row_no", F.floor((F.col("y") + 6) / 40))
    shared = F.least(F.col("y") + 12, F.col("row_no") * 40 + 40) - F.greatest(F.col("y"), F.col("row_no") * 40)
    return w.where(shared >= 8).select("word_id", "row_no", F.when(F.col("x") < 144, "code").when(F.col("x") < 700, "label").otherwise("count").alias("cell"))


@query(
    "review_items_merged",
    """WITH prev AS (SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'accepted' ELSE 'rejected' END AS status FROM part WHERE p_partkey % 2 = 0), nxt AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'accepted' WHEN 2 THEN 'odd' END AS raw FROM part)
 SELECT CAST(n.id AS BIGINT) AS id, CASE WHEN raw = 'pending' THEN 'pending' ELSE coalesce(p.status, CASE WHEN raw IN ('pending', 'accepted', 'rejected') THEN raw END, 'pending') END AS status FROM nxt n LEFT JOIN prev p USING (id)""",
)
def review_items_merged(spark, d):
    """New review items keep an earlier decision, unless they ask to be seen again."""
    part = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), "p_size")
    prev = part.where("id % 2 = 0").select("id", F.when(F.col("p_size") % 3 == 0, "accepted").otherwise("rejected").alias("old"))
    raw = F.when(F.col("p_size") % 4 == 0, "pending").when(F.col("p_size") % 4 == 1, "accepted").when(F.col("p_size") % 4 == 2, "odd")
    known = F.when(F.col("raw").isin("pending", "accepted", "rejected"), F.col("raw"))
    joined = part.withColumn("raw", raw).join(prev, "id", "left")
    return joined.select("id", F.when(F.col("raw") == "pending", "pending").otherwise(F.coalesce("old", known, F.lit("pending"))).alias("status"))


@query("run_lookup", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 7 = 3)")
def run_lookup(spark, d):
    """One run by its key, which the scan filters by."""
    orders = table(spark, d, "orders")
    key = orders.where("o_orderkey % 7 = 3").agg(F.max("o_orderkey").alias("o_orderkey"))
    return orders.select("o_orderkey", "o_totalprice").join(F.broadcast(key), "o_orderkey", "left_semi")  # one row


@query("visible_projects", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND c_acctbal >= 0")
def visible_projects(spark, d):
    """Projects that their owner's scope covers and that aren't archived."""
    scope = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return table(spark, d, "customer").where("c_acctbal >= 0").join(scope, "c_nationkey", "left_semi").select("c_custkey", "c_name")


@query(
    "template_files",
    """WITH f AS (SELECT lpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0') || '_' || lower(replace(p_name, ' ', '_')) AS name FROM part), q AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) AS id FROM part WHERE p_size > 25)
 SELECT id, name FROM (SELECT q.id, f.name, row_number() OVER (PARTITION BY q.id ORDER BY f.name <> q.id, f.name) AS k FROM q JOIN f ON f.name = q.id OR substr(f.name, 4) = q.id) WHERE k = 1""",
)
def template_files(spark, d):
    """A template's file: of exactly that name, else the first with a number before it."""
    low = F.lower(F.replace("p_name", F.lit(" "), F.lit("_")))
    part = table(spark, d, "part")
    files = part.select(F.concat(F.lpad((F.col("p_partkey") % 90).cast("string"), 2, "0"), F.lit("_"), low).alias("name")).distinct()
    keyed = files.select("name", F.explode(F.array(F.struct(F.col("name").alias("id"), F.lit(0).alias("far")), F.struct(F.substring("name", 4, 1000).alias("id"), F.lit(1).alias("far")))).alias("k")).select("name", "k.*")
    asked = part.where("p_size > 25").select(low.alias("id")).distinct()
    return asked.join(keyed, "id").groupBy("id").agg(F.min_by("name", F.struct("far", "name")).alias("name"))


@query("exclusions_off_legend", with_hits(", legend AS (SELECT plan_id, min(x) AS x, min(y) AS y, CAST(300 AS BIGINT) AS w, CAST(200 AS BIGINT) AS h FROM hits WHERE template_id = 1 GROUP BY plan_id), e AS (SELECT hit_id, plan_id, x, y, w * 4 AS w, h * 4 AS h FROM hits WHERE template_id = 2) SELECT e.hit_id FROM e LEFT JOIN legend l USING (plan_id) WHERE l.x IS NULL OR least(e.x + e.w, l.x + l.w) <= greatest(e.x, l.x) OR least(e.y + e.h, l.y + l.h) <= greatest(e.y, l.y)"))
def exclusions_off_legend(spark, d):
    """Excluded zones, but for those that meet the legend of their plan."""
    h = hits(spark, d)
    legend = h.where("template_id = 1").groupBy("plan_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).select("plan_id", "x", "y", F.lit(300).cast("long").alias("w"), F.lit(200).cast("long").alias("h"))
    zones = h.where("template_id = 2").select("hit_id", "plan_id", "x", "y", (F.col("w") * 4).alias("w"), (F.col("h") * 4).alias("h"))
    return S.spatial_semi(zones, legend, S.overlapping, ["plan_id"], "hit_id", anti=True, cell=256).select("hit_id")


@query("hidden_layer_text", "WITH words AS (SELECT CAST(p_partkey AS BIGINT) AS word_id, p_size, p_brand || '/' || p_type AS layer FROM part) SELECT word_id FROM words w WHERE NOT EXISTS (SELECT 1 FROM words v WHERE v.p_size IN (1, 2) AND v.layer = w.layer)")
def hidden_layer_text(spark, d):
    """Words, without those of layers that a request hides by exactly their name."""
    words = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("word_id"), "p_size", F.concat_ws("/", "p_brand", "p_type").alias("layer"))
    hidden = words.where("p_size in (1, 2)").select("layer").distinct()
    return words.join(hidden, "layer", "left_anti").select("word_id")


@query("described_shapes", with_hits("SELECT a.hit_id FROM hits a WHERE a.template_id = 3 AND EXISTS (SELECT 1 FROM hits b WHERE b.plan_id = a.plan_id AND b.template_id = 4 AND b.x > a.x AND b.x - a.x <= 400 AND abs(b.y - a.y) <= 30)"))
def described_shapes(spark, d):
    """Shapes that have a description in their row, to their right."""
    h = hits(spark, d).select("hit_id", "plan_id", "template_id", "x", "y", F.lit(1).cast("long").alias("w"), F.lit(1).cast("long").alias("h"))
    right = lambda a, b: (b.x > a.x) & (b.x - a.x <= 400) & (F.abs(b.y - a.y) <= 30)
    return S.spatial_semi(h.where("template_id = 3"), h.where("template_id = 4").drop("hit_id"), right, ["plan_id"], "hit_id", cell=256, pad=401).select("hit_id")


@query("name_classes", "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN regexp_matches(n, '^1[0-2]_') THEN 'switch' WHEN regexp_matches(n, '^0[679]_') THEN 'socket' WHEN regexp_matches(n, '(^|_)l[0-9]*(_|$)') THEN 'l_group' WHEN regexp_matches(n, 'tb *11') THEN 'tb11' WHEN regexp_matches(n, 'pel') THEN 'pel' ELSE 'other' END AS kind, regexp_extract(n, '^([0-9]+)_', 1) AS code FROM (SELECT p_partkey, lpad(CAST(p_partkey % 20 AS VARCHAR), 2, '0') || '_' || lower(replace(p_name, ' ', '_')) || CASE WHEN p_size % 5 = 0 THEN '_tb11' WHEN p_size % 7 = 0 THEN '_l2' WHEN p_size % 11 = 0 THEN 'pel' ELSE '' END AS n FROM part)")
def name_classes(spark, d):
    """Kinds of templates by their names, the first that fits, and their number."""
    size = F.col("p_size")
    tail = F.when(size % 5 == 0, "_tb11").when(size % 7 == 0, "_l2").when(size % 11 == 0, "pel").otherwise("")
    n = F.concat(F.lpad((F.col("p_partkey") % 20).cast("string"), 2, "0"), F.lit("_"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), tail)
    # The patterns of the kinds of templates, in order.
    kinds = [("switch", "^1[0-2]_"), ("socket", "^0[679]_"), ("l_group", "(^|_)l[0-9]*(_|$)"), ("tb11", "tb *11"), ("pel", "pel")]
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), n.alias("n"))
    return rows.select("id", F.coalesce(*(F.when(F.col("n").rlike(p), k) for k, p in kinds), F.lit("other")).alias("kind"), F.regexp_extract("n", "^([0-9]+)_", 1).alias("code"))


@query("kept_fragments", "WITH r AS (SELECT p_brand, p_partkey, p_name, p_size, lag(p_name) OVER w AS pn, lag(p_size) OVER w AS ps FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey)) SELECT CAST(p_partkey AS BIGINT) AS id FROM r WHERE NOT coalesce(pn = p_name AND p_size < ps, false)")
def kept_fragments(spark, d):
    """Rows, without those that repeat the name of the row before them and are smaller."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    repeats = (F.lag("p_name").over(w) == F.col("p_name")) & (F.col("p_size") < F.lag("p_size").over(w))
    return table(spark, d, "part").withColumn("again", F.coalesce(repeats, F.lit(False))).where("not again").select(F.col("p_partkey").cast("long").alias("id"))
