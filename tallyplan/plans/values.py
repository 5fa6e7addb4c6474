"""Values of single rows: names, times, scores, checks and options."""

from pyspark.sql import functions as F

from tallyplan.functions import geometry as G
from tallyplan.functions import text as X
from tallyplan.plans.base import hits, query, table, with_hits
from tallyplan.plans.rules import measured, with_measured


def _part(spark, d):
    return table(spark, d, "part").withColumn("id", F.col("p_partkey").cast("long"))


@query("safe_names", r"SELECT CAST(p_partkey AS BIGINT) AS id, coalesce(nullif(regexp_replace(regexp_replace(lower(p_type || ' #' || p_size || '.png'), '\.[^.]*$', ''), '[^a-z0-9]+', '_', 'g'), ''), 'template') AS stem, regexp_extract(lpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0') || '_old', '^([0-9]+_)', 1) || regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS renamed FROM part")
def safe_names(spark, d):
    """A file's safe stem; a renamed template keeps its number."""
    name = F.lower(F.concat("p_type", F.lit(" #"), "p_size", F.lit(".png")))
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[^a-z0-9]+", "_")
    old = F.concat(F.lpad((F.col("p_partkey") % 90).cast("string"), 2, "0"), F.lit("_old"))
    renamed = F.concat(F.regexp_extract(old, "^([0-9]+_)", 1), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]+", "_"))
    return _part(spark, d).select("id", F.when(stem == "", "template").otherwise(stem).alias("stem"), renamed.alias("renamed"))


@query("label_trims", "SELECT CAST(doc_id AS BIGINT) AS id, substr(trim(coalesce(text, '')), 1, 120) AS label, length(regexp_extract(coalesce(text, ''), '[A-Za-z0-9]+', 0)) BETWEEN 1 AND 3 AS short FROM documents")
def label_trims(spark, d):
    """Labels of up to 120 characters; whether the first token is short."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring(F.trim(text), 1, 120).alias("label"), F.length(F.regexp_extract(text, "[A-Za-z0-9]+", 0)).between(1, 3).alias("short"))


@query("layer_names", "SELECT DISTINCT p_type AS layer, lower(strip_accents(trim(p_type))) AS k FROM part UNION SELECT t.a, t.b FROM (VALUES ('Łazienka  Ż', 'łazienka z'), ('GNIAZDA ąęó', 'gniazda aeo')) t(a, b)")
def layer_names(spark, d):
    """Layer names in normal form: Latin-1 readings of UTF-8 mended, case folded, accents off, spaces single."""
    asked = spark.createDataFrame([("Łazienka  Ż",), ("GNIAZDA ąęó",)], "layer string")
    return table(spark, d, "part").select(F.col("p_type").alias("layer")).union(asked).distinct().select("layer", X.layer_key(F.col("layer")).alias("k"))


@query("box_labels", with_hits("SELECT hit_id, printf('%02d @ (%d,%d) %dx%d m=%.2f', template_id, x, y, w, h, match_pct / 100.0) AS label FROM hits"))
def box_labels(spark, d):
    return hits(spark, d).select("hit_id", F.format_string("%02d @ (%d,%d) %dx%d m=%.2f", "template_id", "x", "y", "w", "h", F.col("match_pct") / 100.0).alias("label"))


@query("date_keys", "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE epoch_ms(o_orderdate) END AS k FROM orders")
def date_keys(spark, d):
    """A date as a sort key; what is no date comes first."""
    raw = F.when(F.col("o_orderkey") % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(F.unix_millis(F.try_to_timestamp(raw)), F.lit(0)).alias("k"))


@query("elapsed_times", "SELECT event_id, date_diff('millisecond', TIMESTAMP '2024-01-01 00:00:00', date_trunc('millisecond', ts)) AS ms FROM events")
def elapsed_times(spark, d):
    """Milliseconds since a start."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, d, "events").select("event_id", (F.unix_millis(F.col("ts").cast("timestamp")) - F.unix_millis(start)).alias("ms"))


@query("component_scores", with_hits("SELECT hit_id, round(abs(ln(w * h / 900.0)) + 0.35 * abs(ln((w / CAST(h AS DOUBLE)) / 1.2)), 6) AS score FROM hits"))
def component_scores(spark, d):
    """How far a component's area and aspect are from a template's."""
    score = F.abs(F.log(F.col("w") * F.col("h") / 900.0)) + 0.35 * F.abs(F.log(F.col("w") / F.col("h") / 1.2))
    return hits(spark, d).select("hit_id", F.round(score, 6).alias("score"))


@query("percent_shown", with_measured("s AS (SELECT hit_id, least(1000, greatest(0, (content_ratio * 37 - 200))) AS tenths FROM measured) SELECT hit_id, tenths FROM s"))
def percent_shown(spark, d):
    """Shares as tenths of a percent, from 0 to 1000."""
    return measured(spark, d).select("hit_id", F.least(F.lit(1000), F.greatest(F.lit(0), F.col("content_ratio") * 37 - 200)).alias("tenths"))


@query("options_parsed", "SELECT event_id, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 7) AS number, lower(event_type) IN ('1', 'true', 'yes', 'on', 'click', 'view') AS flag FROM events")
def options_parsed(spark, d):
    """Options from text: a whole number or its default, and a flag."""
    # What counts as yes.
    yes = ["1", "true", "yes", "on", "click", "view"]
    return table(spark, d, "events").select("event_id", F.coalesce(F.regexp_extract("props", "([0-9]+)", 1).try_cast("long"), F.lit(7)).alias("number"), F.lower("event_type").isin(*yes).alias("flag"))


@query("kernel_sizes", with_hits("SELECT hit_id, CASE WHEN (w // 4) % 2 = 0 THEN greatest(1, w // 4 + 1) ELSE greatest(1, w // 4) END AS odd, least(255, greatest(1, x - 100)) AS threshold FROM hits"))
def kernel_sizes(spark, d):
    """Odd kernel sizes, and thresholds within a byte."""
    size = F.floor(F.col("w") / 4)
    return hits(spark, d).select("hit_id", F.greatest(F.lit(1), size + F.when(size % 2 == 0, 1).otherwise(0)).alias("odd"), F.least(F.lit(255), F.greatest(F.lit(1), F.col("x") - 100)).alias("threshold"))


@query("file_digests", "SELECT page_id, sha256(html) AS digest, to_base64(encode(substr(url, 1, 60))) AS url64 FROM pages")
def file_digests(spark, d):
    """SHA-256 of a file, and text as base64 in one line, whether or not the session breaks it."""
    url64 = F.translate(F.base64(F.encode(F.substring("url", 1, 60), "UTF-8")), "\r\n", "")
    return table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), url64.alias("url64"))


@query("zone_rectangles", "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(round(p_retailprice / 10) AS BIGINT) AS x, CAST(p_size - 5 AS BIGINT) AS w FROM part WHERE p_size - 5 > 0 AND p_partkey % 9 <> 0")
def zone_rectangles(spark, d):
    """Asked zones as whole rectangles; missing and empty ones are none."""
    zone = F.when(F.col("p_partkey") % 9 != 0, F.struct(F.round(F.col("p_retailprice") / 10).cast("long").alias("x"), (F.col("p_size") - 5).cast("long").alias("w")))
    return _part(spark, d).select("id", zone.alias("z")).where("z.w > 0").select("id", "z.x", "z.w")


@query("focused_symbols", "WITH n AS (SELECT CAST(p_partkey AS BIGINT) AS id, lpad(CAST(p_partkey % 30 AS VARCHAR), 2, '0') || '_' || p_name AS name FROM part) SELECT id FROM n WHERE split_part(name, '_', 1) IN ('06', '07', '11')")
def focused_symbols(spark, d):
    """Symbols of the focused numbers; a star or ``all`` would take every one."""
    focus = ("06", "07", "11")
    name = F.concat(F.lpad((F.col("p_partkey") % 30).cast("string"), 2, "0"), F.lit("_"), "p_name")
    every = F.lit(bool({"*", "all"} & set(focus)))
    return _part(spark, d).where(every | F.split(name, "_")[0].isin(*focus)).select("id")


@query("upload_checks", "SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN trim(p_name) = '' THEN 'blank_name' WHEN NOT lower(f) LIKE '%.pdf' THEN 'not_a_pdf' WHEN length(p_type) < 8 THEN 'short_password' END AS reason FROM (SELECT *, p_name || CASE WHEN p_size % 3 = 0 THEN '.PDF' WHEN p_size % 3 = 1 THEN '.pdf' ELSE '.png' END AS f FROM part)")
def upload_checks(spark, d):
    """Why an upload is turned down, the first reason; none if it isn't."""
    file = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, ".PDF").when(F.col("p_size") % 3 == 1, ".pdf").otherwise(".png"))
    reason = F.when(F.trim("p_name") == "", "blank_name").when(~F.lower(file).endswith(".pdf"), "not_a_pdf").when(F.length("p_type") < 8, "short_password")
    return _part(spark, d).select("id", reason.alias("reason"))


@query("modes_normalised", "SELECT event_id, CASE WHEN lower(trim(m)) IN ('auto', 'color', 'gray') THEN lower(trim(m)) ELSE 'auto' END AS profile FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' Gray' WHEN 1 THEN 'COLOR' WHEN 2 THEN event_type END AS m FROM events)")
def modes_normalised(spark, d):
    """A named mode in normal form; unknown and missing ones are automatic."""
    k = F.col("event_id") % 5
    raw = F.when(k == 0, " Gray").when(k == 1, "COLOR").when(k == 2, F.col("event_type"))
    clean = F.lower(F.trim(raw))
    return table(spark, d, "events").select("event_id", F.when(clean.isin("auto", "color", "gray"), clean).otherwise("auto").alias("profile"))


@query("runtime_options", "SELECT event_id, coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN event_type END, ''), CASE WHEN event_id % 2 = 0 THEN 'env' END, 'none') AS symbols, coalesce(CASE WHEN event_id % 4 = 0 THEN event_id % 90 END, 35) AS radius FROM events")
def runtime_options(spark, d):
    """Options of a run: the request's, else the environment's, else the default."""
    e = F.col("event_id")
    asked = F.when(e % 3 == 0, F.col("event_type"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.when(asked != "", asked), F.when(e % 2 == 0, "env"), F.lit("none")).alias("symbols"), F.coalesce(F.when(e % 4 == 0, e % 90), F.lit(35)).alias("radius"))


@query("pictogram_cores", with_measured("p AS (SELECT hit_id FROM measured WHERE gray = 0 AND text = 1 AND aspect <= 140 AND content_ratio >= 35 AND major >= 70 AND minor >= 40) SELECT hit_id FROM p"))
def pictogram_cores(spark, d):
    """Colour pictograms that were taken for labels: nearly square and filled both ways."""
    return measured(spark, d).where("gray = 0 and text = 1 and aspect <= 140 and content_ratio >= 35 and major >= 70 and minor >= 40").select("hit_id")


@query("row_bounds", with_hits("SELECT plan_id, line, min(x) AS x, greatest(0, min(y) - (max(y + h) - min(y)) // 8) AS y, max(x + w) AS right, max(y + h) + (max(y + h) - min(y)) // 8 AS bottom FROM hits GROUP BY plan_id, line"))
def row_bounds(spark, d):
    """Bounds of a row of boxes, higher by an eighth on either side."""
    g = hits(spark, d).groupBy("plan_id", "line").agg(F.min("x").alias("x"), F.min("y").alias("top"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("low"))
    pad = F.floor((F.col("low") - F.col("top")) / 8)
    return g.select("plan_id", "line", "x", F.greatest(F.lit(0), F.col("top") - pad).alias("y"), "right", (F.col("low") + pad).alias("bottom"))


@query("color_similarities", with_hits("SELECT hit_id, CASE WHEN dd > 36 THEN 0.0 ELSE round(1 - dd / 36.0, 6) END AS similarity FROM (SELECT hit_id, least(abs(x % 180 - y % 180), 180 - abs(x % 180 - y % 180)) AS dd FROM hits)"))
def color_similarities(spark, d):
    """Similarity of two hues, by their distance on the circle."""
    return hits(spark, d).select("hit_id", F.round(G.color_similarity(G.hue_distance(F.col("x") % 180, F.col("y") % 180)), 6).alias("similarity"))


@query("email_keys", "SELECT CAST(c_custkey AS BIGINT) AS id, lower(trim('  ' || c_name || '@Mail.Example ')) AS email FROM customer")
def email_keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), X.email_key(F.concat(F.lit("  "), "c_name", F.lit("@Mail.Example "))).alias("email"))


@query("scene_rows", "SELECT page_id, CAST(page_id % 7 AS BIGINT) AS page, CAST((page_id * 90) % 360 AS BIGINT) AS rotation, CASE WHEN (page_id * 90) % 180 = 90 THEN '1100x850' ELSE '850x1100' END AS raster, substr(sha256(html), 1, 16) AS digest FROM pages")
def scene_rows(spark, d):
    """How a page became a raster: page, turn, size and what it was made from."""
    turn = F.col("page_id") * 90 % 360
    return table(spark, d, "pages").select("page_id", (F.col("page_id") % 7).alias("page"), turn.alias("rotation"), F.when(turn % 180 == 90, "1100x850").otherwise("850x1100").alias("raster"), F.substring(F.sha2(F.col("html").cast("binary"), 256), 1, 16).alias("digest"))
