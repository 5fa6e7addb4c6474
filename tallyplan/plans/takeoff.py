"""Take-off reports."""

from pyspark.sql import functions as F

from tallyplan.operators import takeoff as T
from tallyplan.plans.base import hits, query, table, with_hits


def _boxes(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("label"), F.col("l_orderkey").alias("ordinal"), F.lit(None).cast("string").alias("color"))


@query(
    "takeoff_by_label",
    """WITH c AS (SELECT p_brand AS symbol, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
 l AS (SELECT p_brand AS symbol, min(p_type) AS label FROM part GROUP BY p_brand),
 r AS (SELECT label, CAST(sum(n) AS BIGINT) AS n, count(*) AS symbols FROM c JOIN l USING (symbol) GROUP BY label)
 SELECT label, n, symbols FROM r UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), CAST(sum(symbols) AS BIGINT) FROM r""",
)
def takeoff_by_label(spark, d):
    """Counts by brand, rolled up by the brand's label, with a grand total."""
    counts = T.count_by_symbol(_boxes(spark, d))
    labels = table(spark, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_type").alias("label"))
    rows = T.roll_up(counts, labels).select("label", "n", F.size("symbols").cast("long").alias("symbols"))
    return rows.rollup("label").agg(F.sum("n").alias("n"), F.sum("symbols").alias("symbols"), F.grouping("label").alias("g")).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("label")).alias("label"), "n", "symbols").orderBy("label")


@query(
    "takeoff_boxes_over_results",
    """SELECT p_brand AS symbol, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
)
def takeoff_boxes_over_results(spark, d):
    """Any box at all makes pre-aggregated results count for nothing."""
    results = table(spark, d, "part").select(F.col("p_brand").alias("symbol"), F.lit(99).cast("long").alias("n"), F.lit(None).cast("string").alias("color"), F.col("p_partkey").alias("ordinal"))
    return T.count_by_symbol(_boxes(spark, d), results).select("symbol", "n")


@query(
    "takeoff_results_only",
    """SELECT p_brand AS symbol, CAST(sum(greatest(0, p_size - 25)) AS BIGINT) AS n FROM part GROUP BY p_brand""",
)
def takeoff_results_only(spark, d):
    """Without boxes the results count, negative ones as 0."""
    results = table(spark, d, "part").select(F.col("p_brand").alias("symbol"), (F.col("p_size") - 25).cast("long").alias("n"), F.lit(None).cast("string").alias("color"), F.col("p_partkey").alias("ordinal"))
    return T.count_by_symbol(_boxes(spark, d).limit(0), results).select("symbol", "n")


@query(
    "detections_legend_subtract",
    with_hits("SELECT template_id, count(*) AS n, greatest(0, count(*) - CASE WHEN template_id % 2 = 0 THEN 1 ELSE 0 END) AS reported FROM hits GROUP BY template_id"),
)
def detections_legend_subtract(spark, d):
    """Colour templates (even ids here) give up the legend's own hit; gray ones never do."""
    return T.subtract_legend(hits(spark, d), F.col("template_id") % 2 == 0)


@query(
    "price_extension",
    """SELECT p_brand AS symbol, count(*) AS n, CAST(sum(CAST(round(coalesce(p_retailprice, 0) * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
)
def price_extension(spark, d):
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    priced = li.join(part, li["l_partkey"] == part["p_partkey"])
    return priced.groupBy(F.col("p_brand").alias("symbol")).agg(F.count("*").alias("n"), F.sum(F.round(F.coalesce("p_retailprice", F.lit(0.0)) * 100).cast("long")).alias("cents"))


@query(
    "result_payload",
    with_hits("SELECT plan_id, template_id, count(*) AS n, string_agg(hit_id, ',' ORDER BY verif_pct DESC, match_pct DESC, hit_id) AS ids FROM hits GROUP BY plan_id, template_id"),
)
def result_payload(spark, d):
    """A plan's results by symbol with their boxes, best first; a group is what a plan holds of one symbol."""
    one = F.struct((-F.col("verif_pct")).alias("v"), (-F.col("match_pct")).alias("m"), "hit_id")
    return hits(spark, d).groupBy("plan_id", "template_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s["hit_id"]), ",").alias("ids"))


@query(
    "flatten_results",
    with_hits("SELECT plan_id, template_id, hit_id, x, y, w, h FROM hits"),
)
def flatten_results(spark, d):
    """A plan's grouped results exploded to boxes again."""
    grouped = hits(spark, d).groupBy("plan_id", "template_id").agg(F.collect_list(F.struct("hit_id", "x", "y", "w", "h")).alias("boxes"))
    return grouped.select("plan_id", "template_id", F.explode("boxes").alias("b")).select("plan_id", "template_id", "b.*")
