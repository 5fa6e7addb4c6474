"""Counts, lists and their limits: histograms, top entries, merges of lists, segments."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyplan.plans.base import hits, query, table, with_hits
from tallyplan.plans.rules import measured, with_measured


@query("raw_hits_by_source", with_measured("s AS (SELECT source, count(*) AS n, count(DISTINCT template_id) AS templates FROM measured GROUP BY source) SELECT * FROM s"))
def raw_hits_by_source(spark, d):
    """Raw hits by the mask that they come from."""
    return measured(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("template_id").alias("templates"))


@query("region_histograms", with_measured("r AS (SELECT plan_id, count(*) AS hits, count(*) FILTER (WHERE scale < 80) AS small, count(*) FILTER (WHERE scale BETWEEN 80 AND 100) AS middle, count(*) FILTER (WHERE scale > 100) AS large, count(*) FILTER (WHERE verif < 58) AS rejected, max(match) AS best FROM measured GROUP BY plan_id) SELECT * FROM r"))
def region_histograms(spark, d):
    """What a region's scan found, by scale and verdict."""
    scale = F.col("scale")
    return measured(spark, d).groupBy("plan_id").agg(F.count("*").alias("hits"), F.count_if(scale < 80).alias("small"), F.count_if(scale.between(80, 100)).alias("middle"), F.count_if(scale > 100).alias("large"), F.count_if(F.col("verif") < 58).alias("rejected"), F.max("match").alias("best"))


@query("document_diagnostics", "SELECT source, count(*) AS pages, count(DISTINCT lang) AS layers, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS text_chars, CAST(coalesce(sum(len(string_split(text, chr(10)))), 0) AS BIGINT) AS blocks, count(*) FILTER (WHERE text LIKE '%|%') AS tables FROM documents GROUP BY source")
def document_diagnostics(spark, d):
    """What a document holds: pages, layers, characters, blocks and tables."""
    return table(spark, d, "documents").groupBy("source").agg(
        F.count("*").alias("pages"), F.count_distinct("lang").alias("layers"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("text_chars"),
        F.coalesce(F.sum(F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1)))), F.lit(0)).alias("blocks"), F.count_if(F.col("text").contains("|")).alias("tables"),
    )


@query("export_rows", "SELECT min(trim(p_name)) AS name, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part GROUP BY lower(trim(p_name))")
def export_rows(spark, d):
    """Counts per displayed name; names that differ by case or spaces are one."""
    key = F.lower(F.trim("p_name"))
    return table(spark, d, "part").groupBy(key.alias("k")).agg(F.min(F.trim("p_name")).alias("name"), F.count("*").alias("n"), F.sum("p_size").alias("size")).drop("k")


@query("zone_references", with_hits("SELECT plan_id, template_id, n FROM (SELECT plan_id, template_id, count(*) AS n, row_number() OVER (PARTITION BY plan_id ORDER BY count(*) DESC, template_id) AS k FROM hits GROUP BY plan_id, template_id) WHERE k <= 10"))
def zone_references(spark, d):
    """The ten templates that refer to a zone most often."""
    n = hits(spark, d).groupBy("plan_id", "template_id").agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("n"), "template_id"))).where("k <= 10").drop("k")


@query("inspector_top", with_measured("r AS (SELECT plan_id, hit_id, row_number() OVER (PARTITION BY plan_id ORDER BY verif >= 58 DESC, verif DESC, match DESC, coverage DESC, hit_id) AS k FROM measured) SELECT plan_id, hit_id, k FROM r WHERE k <= least(50, greatest(1, 7))"))
def inspector_top(spark, d):
    """An inspected region's first hits: accepted ones, then by verification, match and coverage; from 1 to 50 of them."""
    asked = 7
    order = Window.partitionBy("plan_id").orderBy(F.desc(F.col("verif") >= 58), F.desc("verif"), F.desc("match"), F.desc("coverage"), "hit_id")
    return measured(spark, d).select("plan_id", "hit_id", F.row_number().over(order).cast("long").alias("k")).where(F.col("k") <= min(50, max(1, asked)))


@query("templates_by_pixels", "SELECT CAST(p_partkey AS BIGINT) AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part")
def templates_by_pixels(spark, d):
    """A brand's templates, those of most pixels first."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.row_number().over(w).cast("long").alias("place"))


@query("top_generators", with_measured("g AS (SELECT template_id, source, count(*) AS n FROM measured GROUP BY ALL) SELECT template_id, source, n FROM g ORDER BY n DESC, template_id, source LIMIT 8"))
def top_generators(spark, d):
    """The eight templates and masks that make most raw hits: a report's limit."""
    return measured(spark, d).groupBy("template_id", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template_id", "source").limit(8)


@query("first_differences", with_hits(", x AS (SELECT hit_id, count(*) OVER () AS n, row_number() OVER (ORDER BY hit_id) AS k FROM hits WHERE verif_pct < 46) SELECT CASE WHEN k <= 20 THEN hit_id ELSE '... ' || (n - 20) || ' more' END AS line FROM x WHERE k <= 21"))
def first_differences(spark, d):
    """The first twenty rows of a report, and how many more there are."""
    rows = hits(spark, d).where("verif_pct < 46").select("hit_id")
    shown = rows.orderBy("hit_id").limit(20).select(F.col("hit_id").alias("line"))
    more = rows.agg(F.count("*").alias("n")).where("n > 20").select(F.concat(F.lit("... "), (F.col("n") - 20).cast("string"), F.lit(" more")).alias("line"))
    return shown.unionByName(more)


@query("unresolved_items", with_measured("u AS (SELECT plan_id, hit_id, row_number() OVER (PARTITION BY plan_id ORDER BY verif DESC, hit_id) AS k FROM measured WHERE gray = 1 AND verif BETWEEN 50 AND 57) SELECT plan_id, hit_id FROM u WHERE k <= 40"))
def unresolved_items(spark, d):
    """Up to forty undecided hits of a plan, as its trace shows them."""
    w = Window.partitionBy("plan_id").orderBy(F.desc("verif"), "hit_id")
    return measured(spark, d).where("gray = 1 and verif between 50 and 57").withColumn("k", F.row_number().over(w)).where("k <= 40").select("plan_id", "hit_id")


@query("drafts_in_order", "SELECT CAST(p_partkey AS BIGINT) AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey * 57 % 1200, p_partkey * 91 % 1200, p_partkey) AS place FROM part")
def drafts_in_order(spark, d):
    """Legend drafts by their row, then from left to right."""
    p = F.col("p_partkey").cast("long")
    w = Window.partitionBy("p_brand").orderBy(p * 57 % 1200, p * 91 % 1200, p)
    return table(spark, d, "part").select(p.alias("id"), F.row_number().over(w).cast("long").alias("place"))


@query("merged_unique", "SELECT k, arg_min(name, pos) AS name FROM (SELECT lower(trim(p_name)) AS k, p_name AS name, p_partkey AS pos FROM part WHERE p_size > 25 UNION ALL SELECT lower(trim(p_type)), p_type, 10000000000 + p_partkey FROM part UNION ALL SELECT lower(trim(p_name)), p_name, 20000000000 + p_partkey FROM part) GROUP BY k")
def merged_unique(spark, d):
    """Lists as one, an entry per normal name: the first list's, in order."""
    part = table(spark, d, "part")
    lists = [part.where("p_size > 25").select("p_name", "p_partkey"), part.select(F.col("p_type").alias("p_name"), "p_partkey"), part.select("p_name", "p_partkey")]
    one = None
    for turn, rows in enumerate(lists):
        rows = rows.select(F.lower(F.trim("p_name")).alias("k"), F.col("p_name").alias("name"), F.struct(F.lit(turn).alias("turn"), "p_partkey").alias("pos"))
        one = rows if one is None else one.unionByName(rows)
    return one.groupBy("k").agg(F.min_by("name", "pos").alias("name"))


@query("restored_rescues", with_measured("kept AS (SELECT hit_id, plan_id, template_id, x, y FROM measured WHERE verif >= 70), rescued AS (SELECT hit_id, plan_id, template_id, x, y FROM measured WHERE coverage >= 90) SELECT hit_id FROM kept UNION ALL SELECT r.hit_id FROM rescued r WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.plan_id = r.plan_id AND k.template_id = r.template_id AND k.x = r.x AND k.y = r.y)"))
def restored_rescues(spark, d):
    """What was kept, and what was rescued and isn't there yet."""
    m = measured(spark, d)
    key = ["plan_id", "template_id", "x", "y"]
    kept = m.where("verif >= 70").select("hit_id", *key)
    return kept.select("hit_id").unionByName(m.where("coverage >= 90").select("hit_id", *key).join(kept.select(*key).distinct(), key, "left_anti").select("hit_id"))


@query("shared_families", "WITH f AS (SELECT p_brand, list(DISTINCT substr(p_type, 1, 3)) AS fam FROM part GROUP BY p_brand) SELECT a.p_brand AS a, b.p_brand AS b, CAST(len(list_intersect(a.fam, b.fam)) AS BIGINT) AS shared FROM f a JOIN f b ON a.p_brand < b.p_brand WHERE list_has_any(a.fam, b.fam)")
def shared_families(spark, d):
    """How many token families two brands share."""
    f = table(spark, d, "part").select("p_brand", F.substring("p_type", 1, 3).alias("fam")).distinct()
    pairs = f.join(f.select(F.col("p_brand").alias("b"), "fam"), "fam").where("p_brand < b")
    return pairs.groupBy(F.col("p_brand").alias("a"), "b").agg(F.count("*").alias("shared"))


@query("symbol_names", with_hits("SELECT plan_id, string_agg(DISTINCT CAST(template_id AS VARCHAR), ',' ORDER BY CAST(template_id AS VARCHAR)) AS names FROM hits GROUP BY plan_id"))
def symbol_names(spark, d):
    """A plan's symbols, each once, in order of name."""
    return hits(spark, d).groupBy("plan_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("template_id").cast("string"))), ",").alias("names"))


#: A table's rows: those of a brand in a range of 500 parts, so that tables grow in number and not in size.
_TABLE = "p_brand, p_partkey // 500 AS range_"


def _tables(spark, d):
    return table(spark, d, "part").withColumn("range_", F.floor(F.col("p_partkey") / 500))


@query(
    "gap_segments",
    f"""WITH RECURSIVE t AS (SELECT {_TABLE}, p_partkey, p_size FROM part), r AS (SELECT *, p_size - lag(p_size) OVER w AS gap, row_number() OVER w AS k FROM t WINDOW w AS (PARTITION BY p_brand, range_ ORDER BY p_size, p_partkey)),
 m AS (SELECT p_brand, range_, least(8.0, greatest(2.0, 1.8 * quantile_cont(gap, 0.5))) AS bound FROM r WHERE gap IS NOT NULL GROUP BY ALL),
 walk AS (SELECT p_brand, range_, p_partkey, k, 0 AS segment, 1 AS members FROM r WHERE k = 1
  UNION ALL SELECT r.p_brand, r.range_, r.p_partkey, r.k, segment + CASE WHEN gap > bound AND members >= 3 THEN 1 ELSE 0 END, CASE WHEN gap > bound AND members >= 3 THEN 1 ELSE members + 1 END FROM walk JOIN r ON r.p_brand = walk.p_brand AND r.range_ = walk.range_ AND r.k = walk.k + 1 JOIN m ON m.p_brand = r.p_brand AND m.range_ = r.range_)
 SELECT CAST(p_partkey AS BIGINT) AS id, CAST(segment AS BIGINT) AS segment FROM walk""",
)
def gap_segments(spark, d):
    """Rows of a table in segments: a new one after a gap of more than 1.8 times the median gap, within bounds, if the segment has
    three rows by then. The condition depends on what was split before, so a table's rows are walked in order."""
    key = ["p_brand", "range_"]
    w = Window.partitionBy(*key).orderBy("p_size", "p_partkey")
    r = _tables(spark, d).select(*key, "p_partkey", "p_size").withColumn("gap", F.col("p_size") - F.lag("p_size").over(w))
    g = r.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("p_size", "p_partkey", "gap"))).alias("rows"), F.least(F.lit(8.0), F.greatest(F.lit(2.0), 1.8 * F.percentile("gap", F.lit(0.5)))).alias("bound"))
    first = F.struct(F.lit(0).cast("long").alias("segment"), F.lit(0).cast("long").alias("members"), F.array().cast("array<struct<id:bigint,segment:bigint>>").alias("out"))

    def step(state, row):
        split = F.coalesce((row["gap"] > F.col("bound")) & (state["members"] >= 3), F.lit(False))
        segment = state["segment"] + split.cast("long")
        one = F.struct(row["p_partkey"].cast("long").alias("id"), segment.alias("segment"))
        return F.struct(segment.alias("segment"), F.when(split, F.lit(1)).otherwise(state["members"] + 1).cast("long").alias("members"), F.concat(state["out"], F.array(one)).alias("out"))

    return g.select(F.explode(F.aggregate("rows", first, step)["out"]).alias("o")).select("o.id", "o.segment")


@query(
    "adjacent_chunks",
    "WITH c AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_brand, p_size % 4 AS col, p_partkey AS pos, p_size AS y FROM part) SELECT a.id, arg_min(b.id, b.pos) AS next FROM c a JOIN c b ON a.p_brand = b.p_brand AND a.col = b.col AND b.pos > a.pos AND b.y BETWEEN a.y AND a.y + 12 GROUP BY a.id",
)
def adjacent_chunks(spark, d):
    """The first later chunk of a table in the same column that goes on below."""
    return following_chunks(table(spark, d, "part").select("p_brand", F.col("p_partkey").cast("long").alias("id"), F.col("p_size").alias("y")), 12)


def following_chunks(chunks, reach, run=50_000):
    """(id, next) of ``chunks(p_brand, id, y)``, columns being y modulo 4: a chunk is also put to each y that it follows, where
    the next one in order of id is the answer. Ids are in runs, so that a y of any number of chunks is no single group: the last
    of a run is followed by the first of the next run that has any."""
    at = F.sequence(F.col("y") - reach, F.col("y"))
    put = chunks.where("p_brand is not null and id is not null").withColumn("at", F.explode(at)).where("at % 4 = y % 4")
    put = put.groupBy("p_brand", "at", "id").agg(F.bool_or(F.col("at") == F.col("y")).alias("own")).withColumn("run", F.floor(F.col("id") / run))
    spot = Window.partitionBy("p_brand", "at").orderBy("run")
    runs = put.groupBy("p_brand", "at", "run").agg(F.min("id").alias("first")).withColumn("after", F.lead("first").over(spot)).drop("first")
    near = F.lead("id").over(Window.partitionBy("p_brand", "at", "run").orderBy("id"))
    followed = put.withColumn("near", near).where("own").join(runs, ["p_brand", "at", "run"]).select("id", F.coalesce("near", "after").alias("next"))
    return followed.where("next is not null").groupBy("id").agg(F.min("next").alias("next"))
