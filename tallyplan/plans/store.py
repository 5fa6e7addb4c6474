"""Metadata-store queries: customers own projects, orders are their runs."""

from pyspark.sql import functions as F

from tallyplan.operators import store as S
from tallyplan.plans.base import query, table

CUT = "1997-01-01"


@query(
    "dashboard_latest_per_project",
    """SELECT c.c_custkey, c.c_name, (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS runs,
 (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest_o_orderkey,
 (SELECT o_orderstatus FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest_o_orderstatus FROM customer c""",
)
def dashboard_latest_per_project(spark, d):
    runs = S.latest_of(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])
    owners = table(spark, d, "customer")
    joined = owners.join(runs, owners["c_custkey"] == runs["o_custkey"], "left")
    return joined.select("c_custkey", "c_name", F.coalesce("children", F.lit(0)).alias("runs"), "latest_o_orderkey", "latest_o_orderstatus")


@query("session_user_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND o_orderdate > TIMESTAMP '1997-01-01'")
def session_user_join(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    live = S.expire(o.where("o_orderstatus = 'O'"), "o_orderdate", F.expr(f"timestamp_ntz'{CUT}'"))
    return live.join(c, live["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_name")


@query("semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')")
def semi_exists(spark, d):
    o, c = table(spark, d, "orders").where("o_orderpriority like '1%'"), table(spark, d, "customer")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select("c_custkey")


@query(
    "upsert_preserve_created",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'updated' ELSE o_orderstatus END AS status, o_orderdate AS created_at FROM orders WHERE o_orderkey % 7 <> 0
 UNION ALL SELECT o_orderkey, 'updated', TIMESTAMP '2030-01-01' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 3 = 0""",
)
def upsert_preserve_created(spark, d):
    """Existing runs keep their creation time, new ones get the present one."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at"))
    change = o.where("id % 3 = 0").select("id", F.lit("updated").alias("status"), F.expr("timestamp_ntz'2030-01-01'").alias("created_at"))
    return S.upsert(o.where("id % 7 <> 0"), change, "id", ["created_at"])


@query("soft_delete_filter", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0)")
def soft_delete_filter(spark, d):
    """Projects archived by an update are no longer listed."""
    c = table(spark, d, "customer").withColumn("archived_at", F.lit(None).cast("string"))
    return S.update(c, F.col("c_acctbal") < 0, {"archived_at": F.lit(CUT)}).where("archived_at is null").select("c_custkey")


@query("ttl_expire", "SELECT event_id FROM events WHERE ts + INTERVAL 10 DAY > TIMESTAMP '2024-01-20'")
def ttl_expire(spark, d):
    e = table(spark, d, "events").withColumn("until", F.col("ts") + F.expr("make_dt_interval(10)"))
    return S.expire(e, "until", F.expr("timestamp_ntz'2024-01-20'")).select("event_id")


@query("delete_except", "SELECT o_custkey, count(*) AS deleted FROM orders WHERE o_orderkey NOT IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey) GROUP BY o_custkey")
def delete_except(spark, d):
    """Each owner's sessions but the newest are deleted; how many they were."""
    o = table(spark, d, "orders")
    keep = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return S.delete(o, keep, "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("deleted"))


@query("insert_conflicts", "SELECT o_orderkey % 2 = 0 AS conflict, count(*) AS n FROM orders GROUP BY 1")
def insert_conflicts(spark, d):
    """Inserts of keys that exist are told from new ones."""
    o = table(spark, d, "orders").select("o_orderkey")
    held = o.where("o_orderkey % 2 = 0")
    after, rejected = S.insert_new(held, o, "o_orderkey")
    fresh = after.join(held, "o_orderkey", "left_anti")
    return rejected.agg(F.count("*").alias("n")).select(F.lit(True).alias("conflict"), "n").unionByName(fresh.agg(F.count("*").alias("n")).select(F.lit(False).alias("conflict"), "n"))


@query("cascading_delete", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING'")
def cascading_delete(spark, d):
    parents = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    return S.cascade_delete(parents, table(spark, d, "orders"), "c_custkey", "o_custkey").select("o_orderkey")


@query(
    "single_use_tokens",
    """WITH t AS (SELECT o_orderkey AS token, o_custkey AS owner, o_orderstatus <> 'F' AS open, o_orderdate FROM orders), good AS (SELECT DISTINCT owner FROM t WHERE token % 5 = 0 AND open AND o_orderdate > TIMESTAMP '1996-01-01')
 SELECT count(*) FILTER (WHERE NOT open) + count(*) FILTER (WHERE open AND owner IN (SELECT owner FROM good)) AS consumed, (SELECT count(*) FROM good) AS admitted FROM t""",
)
def single_use_tokens(spark, d):
    now = F.expr("timestamp_ntz'1996-01-01'")
    tokens = table(spark, d, "orders").select(F.col("o_orderkey").alias("token_hash"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("expires_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("consumed_at"))
    after, good = S.consume_token(tokens, tokens.where("token_hash % 5 = 0").select("token_hash"), now)
    return after.agg(F.count("consumed_at").alias("consumed")).crossJoin(good.agg(F.count("*").alias("admitted")))  # one row each


@query("project_search_sort", "SELECT c_custkey, lower(c_name) AS name FROM customer WHERE contains(lower(c_name), '00') OR contains(lower(c_mktsegment), 'auto') ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def project_search_sort(spark, d):
    c = table(spark, d, "customer")
    hit = F.lower("c_name").contains("00") | F.lower("c_mktsegment").contains("auto")
    return c.where(hit).orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).select("c_custkey", F.lower("c_name").alias("name"))


@query("review_edits", "SELECT count(*) AS boxes, CAST(sum(CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) AS BIGINT) AS relabelled, CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem WHERE l_linenumber <> 5")
def review_edits(spark, d):
    """A reviewer's edits: rejected boxes go, others are relabelled."""
    li = table(spark, d, "lineitem").withColumn("symbol", F.lit("auto")).where("l_linenumber <> 5")
    edited = S.update(li, F.col("l_linenumber") == 2, {"symbol": F.lit("manual")})
    return edited.agg(F.count("*").alias("boxes"), F.count_if(F.col("symbol") == "manual").alias("relabelled"), F.sum("l_quantity").cast("long").alias("total"))


@query("perf_top_stages", "SELECT event_type AS stage, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS ms FROM events WHERE event_type <> 'view' GROUP BY 1 ORDER BY ms DESC, stage LIMIT 8")
def perf_top_stages(spark, d):
    """The slowest stages of performance records, totals left out."""
    ms = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").where("event_type <> 'view'").groupBy(F.col("event_type").alias("stage")).agg(F.sum(ms).alias("ms")).orderBy(F.desc("ms"), "stage").limit(8)


@query("count_children", "SELECT n_name, count(c_custkey) AS owners FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name")
def count_children(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("owners"))
    return n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").select("n_name", F.coalesce("owners", F.lit(0)).alias("owners"))
