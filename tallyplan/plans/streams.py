"""Extensions over events; the same functions run on a stream."""

from pyspark.sql import functions as F

from tallyplan.plans.base import query, table
from tallyplan.streaming import progress


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "progress_latest_per_key",
    "SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, count(*) AS n, arg_max(event_type, struct_pack(a := ts, b := event_type)) AS last_type FROM events GROUP BY 1, 2",
)
def progress_latest_per_key(spark, d):
    out = progress.latest_per_key(_events(spark, d), "user_id", "ts", ["event_type"])
    return out.select("user_id", F.floor(F.unix_timestamp("window.start") / 3600).alias("hour"), "n", F.col("last.event_type").alias("last_type"))


@query(
    "gap_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
 SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, count(*) AS n FROM s GROUP BY user_id, k""",
)
def gap_sessions(spark, d):
    return progress.sessions(_events(spark, d), "user_id", "ts", "6 hours").select("user_id", F.unix_timestamp("first").alias("first"), "n")
