"""Reports and payloads of a review: summaries, texts, gates, overrides and display labels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyplan.plans.base import hits, query, table, with_hits
from tallyplan.plans.rules import measured, with_measured


@query("review_payload", with_hits("SELECT plan_id, '{\"plan\":' || plan_id || ',\"rows\":' || count(*) || ',\"accepted\":' || count(*) FILTER (WHERE verif_pct >= 76) || '}' AS payload FROM hits GROUP BY plan_id"))
def review_payload(spark, d):
    """A reviewed plan's metadata as JSON."""
    g = hits(spark, d).groupBy("plan_id").agg(F.count("*").alias("rows"), F.count_if(F.col("verif_pct") >= 76).alias("accepted"))
    return g.select("plan_id", F.to_json(F.struct(F.col("plan_id").alias("plan"), "rows", "accepted")).alias("payload"))


@query("session_metadata", "SELECT event_id, json_extract_string(j, '$.user') AS user, CAST(json_extract(j, '$.n') AS BIGINT) AS n FROM (SELECT event_id, '{\"user\":\"u' || user_id || '\",\"n\":' || event_id % 11 || '}' AS j FROM events)")
def session_metadata(spark, d):
    """Metadata written as JSON and read again."""
    j = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("user"), (F.col("event_id") % 11).alias("n")))
    return table(spark, d, "events").select("event_id", F.from_json(j, "user string, n long").alias("m")).select("event_id", "m.user", "m.n")


@query("case_report", with_hits("SELECT plan_id, '## Plan ' || plan_id || chr(10) || string_agg('- ' || label, chr(10) ORDER BY template_id) AS text FROM (SELECT plan_id, template_id, printf('%02d: %d boxes', template_id, count(*)) AS label FROM hits GROUP BY plan_id, template_id) GROUP BY plan_id"))
def case_report(spark, d):
    """A plan's report as text: a line for each symbol."""
    n = hits(spark, d).groupBy("plan_id", "template_id").agg(F.count("*").alias("n"))
    line = F.struct("template_id", F.format_string("- %02d: %d boxes", "template_id", "n").alias("text"))
    lines = n.groupBy("plan_id").agg(F.array_sort(F.collect_list(line)).alias("lines"))  # one for each symbol
    return lines.select("plan_id", F.concat_ws("\n", F.concat(F.lit("## Plan "), F.col("plan_id").cast("string")), F.transform("lines", lambda x: x["text"])).alias("text"))


@query("review_summary", with_hits("SELECT plan_id, count(*) FILTER (WHERE verif_pct >= 76) AS accepted, count(*) FILTER (WHERE verif_pct < 58) AS rejected, count(*) FILTER (WHERE verif_pct BETWEEN 58 AND 75) AS pending, count(*) FILTER (WHERE line = 1 AND verif_pct >= 76) AS edited FROM hits GROUP BY plan_id"))
def review_summary(spark, d):
    v = F.col("verif_pct")
    return hits(spark, d).groupBy("plan_id").agg(F.count_if(v >= 76).alias("accepted"), F.count_if(v < 58).alias("rejected"), F.count_if(v.between(58, 75)).alias("pending"), F.count_if((F.col("line") == 1) & (v >= 76)).alias("edited"))


@query(
    "gate_steps",
    with_hits(", s AS (SELECT plan_id, line AS step, bool_and(verif_pct >= 41) AS ok FROM hits GROUP BY ALL), f AS (SELECT *, min(CASE WHEN NOT ok THEN step END) OVER (PARTITION BY plan_id) AS failed FROM s) SELECT plan_id, step, CASE WHEN failed IS NULL OR step < failed THEN 'passed' WHEN step = failed THEN 'failed' ELSE 'skipped' END AS status FROM f"),
)
def gate_steps(spark, d):
    """Steps of a quality gate: the first that fails ends it."""
    s = hits(spark, d).groupBy("plan_id", F.col("line").alias("step")).agg(F.bool_and(F.col("verif_pct") >= 41).alias("ok"))
    failed = F.min(F.when(~F.col("ok"), F.col("step"))).over(Window.partitionBy("plan_id"))
    s = s.withColumn("failed", failed)
    return s.select("plan_id", "step", F.when(F.col("failed").isNull() | (F.col("step") < F.col("failed")), "passed").when(F.col("step") == F.col("failed"), "failed").otherwise("skipped").alias("status"))


@query("debug_profile", with_measured("p AS (SELECT plan_id, count(*) AS raw, count(*) FILTER (WHERE gray = 1) AS gray, count(*) FILTER (WHERE text = 1) AS labels, CAST(sum(pixels) AS BIGINT) AS pixels, max(match) AS best FROM measured GROUP BY plan_id) SELECT plan_id, printf('%d/%d/%d', raw, gray, labels) AS counts, pixels, best FROM p"))
def debug_profile(spark, d):
    """What a run did, as one row for each plan."""
    p = measured(spark, d).groupBy("plan_id").agg(F.count("*").alias("raw"), F.count_if(F.col("gray") == 1).alias("gray"), F.count_if(F.col("text") == 1).alias("labels"), F.sum("pixels").alias("pixels"), F.max("match").alias("best"))
    return p.select("plan_id", F.format_string("%d/%d/%d", "raw", "gray", "labels").alias("counts"), "pixels", "best")


#: Preferred over a place's best hit, in turn: what it must be, and how far its score may lie below.
OVERRIDES = [("label", "text = 1 and content >= 85", 6), ("full", "coverage >= 96 and area >= 900", 8), ("clean", "purity >= 90", 3)]


@query(
    "winner_overrides",
    with_measured("""best AS (SELECT plan_id, template_id, max(verif) AS top FROM measured GROUP BY ALL), c AS (SELECT m.*, b.top FROM measured m JOIN best b USING (plan_id, template_id)),
 w0 AS (SELECT plan_id, template_id, arg_min(hit_id, (-verif, -match, hit_id)) AS hit_id, 'best' AS why FROM c GROUP BY ALL),
 w1 AS (SELECT plan_id, template_id, arg_min(hit_id, (-verif, -match, hit_id)) AS hit_id FROM c WHERE text = 1 AND content >= 85 AND verif + 6 >= top GROUP BY ALL),
 w2 AS (SELECT plan_id, template_id, arg_min(hit_id, (-verif, -match, hit_id)) AS hit_id FROM c WHERE coverage >= 96 AND area >= 900 AND verif + 8 >= top GROUP BY ALL),
 w3 AS (SELECT plan_id, template_id, arg_min(hit_id, (-verif, -match, hit_id)) AS hit_id FROM c WHERE purity >= 90 AND verif + 3 >= top GROUP BY ALL)
 SELECT w0.plan_id, w0.template_id, coalesce(w1.hit_id, w2.hit_id, w3.hit_id, w0.hit_id) AS hit_id, CASE WHEN w1.hit_id IS NOT NULL THEN 'label' WHEN w2.hit_id IS NOT NULL THEN 'full' WHEN w3.hit_id IS NOT NULL THEN 'clean' ELSE 'best' END AS why
 FROM w0 LEFT JOIN w1 ON w1.plan_id = w0.plan_id AND w1.template_id = w0.template_id LEFT JOIN w2 ON w2.plan_id = w0.plan_id AND w2.template_id = w0.template_id LEFT JOIN w3 ON w3.plan_id = w0.plan_id AND w3.template_id = w0.template_id"""),
)
def winner_overrides(spark, d):
    """A place's winner: its best hit, unless one that is preferred comes close enough; the first preference that holds."""
    key = ["plan_id", "template_id"]
    m = measured(spark, d)
    c = m.join(m.groupBy(*key).agg(F.max("verif").alias("top")), key)
    order = F.struct(-F.col("verif"), -F.col("match"), "hit_id")
    picks = [F.min_by(F.when(F.expr(rule) & (F.col("verif") + margin >= F.col("top")), F.col("hit_id")), F.when(F.expr(rule) & (F.col("verif") + margin >= F.col("top")), order)).alias(why) for why, rule, margin in OVERRIDES]
    g = c.groupBy(*key).agg(F.min_by("hit_id", order).alias("best"), *picks)
    names = [why for why, _, _ in OVERRIDES]
    return g.select(*key, F.coalesce(*names, "best").alias("hit_id"), F.coalesce(*(F.when(F.col(n).isNotNull(), n) for n in names), F.lit("best")).alias("why"))


@query(
    "display_labels",
    """WITH l AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_name NOT LIKE 'cold%'),
 e AS (SELECT p_brand, CAST(count(*) FILTER (WHERE p_size % 10 <> 3) AS BIGINT) AS wanted FROM part GROUP BY p_brand)
 SELECT l.p_brand, l.k, l.p_name AS label FROM l JOIN e USING (p_brand) WHERE wanted > 0 AND (n = wanted OR (n > wanted AND n <= wanted + greatest(2, wanted // 4))) AND k <= wanted""",
)
def display_labels(spark, d):
    """A legend's labels for its templates, in reading order without headings: only if as many as wanted, or few more."""
    part = table(spark, d, "part")
    own = part.where("p_name not like 'cold%'")
    w = Window.partitionBy("p_brand")
    labels = own.select("p_brand", F.col("p_name").alias("label"), F.row_number().over(w.orderBy("p_size", "p_partkey")).cast("long").alias("k"), F.count("*").over(w).alias("n"))
    wanted = part.groupBy("p_brand").agg(F.count_if(F.col("p_size") % 10 != 3).alias("wanted"))
    fits = (F.col("n") >= F.col("wanted")) & ((F.col("n") == F.col("wanted")) | (F.col("n") <= F.col("wanted") + F.greatest(F.lit(2), F.floor(F.col("wanted") / 4))))
    return labels.join(wanted, "p_brand").where((F.col("wanted") > 0) & fits & (F.col("k") <= F.col("wanted"))).select("p_brand", "k", "label")
