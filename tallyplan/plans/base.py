"""Registry of queries, and the box relations that they derive from the star schema by whole-number formulas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored boxes: a supplier is a plan, a line item a hit. Columns are whole numbers, hit_id is unique."""
    li = table(spark, sf_dir, "lineitem")
    o, n, p, s = (F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    return li.select(
        F.concat_ws("-", o, n, p, s, price).alias("hit_id"), s.alias("plan_id"), ((o * 37 + n * 101) % 1200).alias("x"), ((p * 53 + n * 17) % 1200).alias("y"),
        (p % 17 + 24).alias("w"), (n * 7 % 17 + 24).alias("h"), (p % 29).alias("template_id"),
        (45 + 5 * F.round(F.col("l_discount") * 100).cast("long")).alias("match_pct"), (40 + 6 * F.round(F.col("l_tax") * 100).cast("long")).alias("verif_pct"),
        n.alias("line"), p.alias("part"), o.alias("okey"),
    )


HITS = """hits AS (SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS hit_id,
 CAST(l_suppkey AS BIGINT) AS plan_id, CAST((l_orderkey * 37 + l_linenumber * 101) % 1200 AS BIGINT) AS x, CAST((l_partkey * 53 + l_linenumber * 17) % 1200 AS BIGINT) AS y,
 CAST(l_partkey % 17 + 24 AS BIGINT) AS w, CAST(l_linenumber * 7 % 17 + 24 AS BIGINT) AS h, CAST(l_partkey % 29 AS BIGINT) AS template_id,
 45 + 5 * CAST(round(l_discount * 100) AS BIGINT) AS match_pct, 40 + 6 * CAST(round(l_tax * 100) AS BIGINT) AS verif_pct,
 CAST(l_linenumber AS BIGINT) AS line, CAST(l_partkey AS BIGINT) AS part, CAST(l_orderkey AS BIGINT) AS okey FROM lineitem)"""


def with_hits(body: str) -> str:
    return f"WITH {HITS}{body}" if body.lstrip().startswith(",") else f"WITH {HITS} {body}"


#: SQL for the geometry of two hits a and b.
INTER = "(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)))"
D2 = "((2*a.x + a.w - 2*b.x - b.w) * (2*a.x + a.w - 2*b.x - b.w) + (2*a.y + a.h - 2*b.y - b.h) * (2*a.y + a.h - 2*b.y - b.h))"
WITHIN = "(2*{0}.x + {0}.w BETWEEN 2*{1}.x AND 2*({1}.x + {1}.w) AND 2*{0}.y + {0}.h BETWEEN 2*{1}.y AND 2*({1}.y + {1}.h))"
DIAG = "least(a.w*a.w + a.h*a.h, b.w*b.w + b.h*b.h) * 4"
CLUSTERS = f"""({INTER} > 0 AND (({INTER} * 100 >= (a.w*a.h + b.w*b.h - {INTER}) * 30 AND {D2} * 1000000 <= {DIAG} * 78400)
 OR ({INTER} * 100 >= least(a.w*a.h, b.w*b.h) * 72 AND ({WITHIN.format('a', 'b')} OR {WITHIN.format('b', 'a')}) AND {D2} * 1000000 <= {DIAG} * 103684)))"""
EDGES = f"edges AS (SELECT a.hit_id AS a, b.hit_id AS b FROM hits a JOIN hits b ON a.plan_id = b.plan_id AND a.hit_id < b.hit_id WHERE {CLUSTERS})"
PARTS = """both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
 reach(node, seen) AS (SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.seen = e.a),
 parts AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""
