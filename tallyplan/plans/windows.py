"""Row grouping, bands and windows over events as positions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyplan.operators import layout as L
from tallyplan.plans.base import query, table

_POS = "p AS (SELECT user_id, event_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS pos, value FROM events)"


def positions(spark, d):
    e = table(spark, d, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return e.select("user_id", "event_id", F.floor(seconds / 60).alias("pos"), "value")


_ISLANDS = f"{_POS}, g AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos, event_id) > 720 THEN 1 ELSE 0 END AS new FROM p), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g)"


@query("merge_close_indices", f"WITH {_ISLANDS} SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, CAST(floor(quantile_cont(pos, 0.5)) AS BIGINT) AS middle FROM i GROUP BY user_id, island")
def merge_close_indices(spark, d):
    """Positions within twelve hours of the one before belong together; each group's median stands for it."""
    rows = L.islands(positions(spark, d), ["user_id"], "pos", "event_id", 720)
    return rows.groupBy("user_id", F.col("island").cast("long").alias("island")).agg(F.count("*").alias("n"), F.floor(F.percentile("pos", F.lit(0.5))).alias("middle"))


@query("group_splits", f"WITH {_ISLANDS} SELECT user_id, CAST(max(island) AS BIGINT) + 1 AS parts FROM i GROUP BY user_id")
def group_splits(spark, d):
    rows = L.islands(positions(spark, d), ["user_id"], "pos", "event_id", 720)
    return rows.groupBy("user_id").agg((F.max("island") + 1).cast("long").alias("parts"))


@query("row_grouping_gaps")
def row_grouping_gaps(spark, d):
    """Groups by the running mean, an ordered fold per user."""
    return L.running_mean_groups(positions(spark, d), "user_id", "pos", 500)


@query(
    "row_bands",
    f"WITH {_POS}, c AS (SELECT DISTINCT user_id, pos FROM p) SELECT user_id, pos, coalesce((pos + lag(pos) OVER w) / 2.0, pos - 30.0) AS top, coalesce((pos + lead(pos) OVER w) / 2.0, pos + 30.0) AS bottom FROM c WINDOW w AS (PARTITION BY user_id ORDER BY pos)",
)
def row_bands(spark, d):
    rows = positions(spark, d).select("user_id", "pos").distinct()
    return L.row_bands(rows, ["user_id"], "pos", 30.0).select("user_id", "pos", F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"))


@query(
    "best_window_n_rows",
    """WITH e AS (SELECT event_type, event_id, CAST(round(value * 100) AS BIGINT) AS v FROM events), s AS (SELECT *, count(*) OVER w AS n, CAST(sum(CASE WHEN v > 5000 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS strong_rows, CAST(sum(v) OVER w AS BIGINT) AS total FROM e WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
 SELECT event_type, event_id AS start, strong_rows, total FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY strong_rows DESC, total DESC, event_id) AS r FROM s WHERE n = 10) WHERE r = 1""",
)
def best_window_n_rows(spark, d):
    rows = table(spark, d, "events").select("event_type", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    return L.best_window(rows, ["event_type"], "event_id", F.col("v") > 5000, F.col("v"), 10)


@query("boundary_spans", f"WITH {_POS}, c AS (SELECT DISTINCT user_id, pos FROM p) SELECT user_id, pos AS top, nxt AS bottom FROM (SELECT user_id, pos, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) AS nxt FROM c) WHERE nxt - pos >= 300")
def boundary_spans(spark, d):
    rows = positions(spark, d).select("user_id", "pos").distinct()
    nxt = F.lead("pos").over(Window.partitionBy("user_id").orderBy("pos"))
    return rows.select("user_id", F.col("pos").alias("top"), nxt.alias("bottom")).where("bottom - top >= 300")


@query("line_runs", f"WITH {_POS}, s AS (SELECT user_id, pos, event_id, value > 50 AS ink FROM p), f AS (SELECT *, CASE WHEN ink AND NOT coalesce(lag(ink) OVER (PARTITION BY user_id ORDER BY pos, event_id), false) THEN 1 ELSE 0 END AS opens FROM s) SELECT user_id, CAST(sum(opens) AS BIGINT) AS runs FROM f GROUP BY user_id")
def line_runs(spark, d):
    """Runs of inked positions."""
    ink = positions(spark, d).withColumn("ink", F.col("value") > 50)
    opens = F.col("ink") & ~F.coalesce(F.lag("ink").over(Window.partitionBy("user_id").orderBy("pos", "event_id")), F.lit(False))
    return ink.withColumn("opens", opens.cast("long")).groupBy("user_id").agg(F.sum("opens").alias("runs"))


@query("median_gaps", f"WITH {_POS}, c AS (SELECT DISTINCT user_id, pos FROM p), g AS (SELECT user_id, lead(pos) OVER (PARTITION BY user_id ORDER BY pos) - pos AS gap FROM c) SELECT user_id, quantile_cont(gap, 0.5) AS median, max(gap) AS widest FROM g WHERE gap IS NOT NULL GROUP BY user_id")
def median_gaps(spark, d):
    rows = positions(spark, d).select("user_id", "pos").distinct()
    gaps = rows.select("user_id", (F.lead("pos").over(Window.partitionBy("user_id").orderBy("pos")) - F.col("pos")).alias("gap")).where("gap is not null")
    return gaps.groupBy("user_id").agg(F.percentile("gap", F.lit(0.5)).alias("median"), F.max("gap").alias("widest"))
