"""Metadata tables as DataFrames: inserts, upserts, deletes and expiry are rewrites of a table by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_new(table: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table with the rows of new keys, rejected rows): a key that exists is a conflict."""
    fresh = rows.join(table.select(key), key, "left_anti")
    return table.unionByName(fresh), rows.join(table.select(key), key, "left_semi")


def upsert(table: DataFrame, rows: DataFrame, key: str, preserve: list[str] | None = None) -> DataFrame:
    """Rows replace those of their key; preserved columns keep the old value where there is one."""
    preserve = preserve or []
    old = table.select(key, *(F.col(c).alias(f"_{c}") for c in preserve))
    merged = rows.join(old, key, "left") if preserve else rows
    for c in preserve:
        merged = merged.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c))).drop(f"_{c}")
    return table.join(rows.select(key), key, "left_anti").unionByName(merged.select(table.columns))


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return table.withColumns({c: F.when(F.coalesce(where, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def cascade_delete(parents: DataFrame, child: DataFrame, parent_key: str, child_ref: str) -> DataFrame:
    """Children whose parent is still there."""
    return child.join(parents.select(F.col(parent_key).alias(child_ref)), child_ref, "left_semi")


def expire(table: DataFrame, until: str, now: Column) -> DataFrame:
    """Rows whose expiry lies after now; at that very moment they have expired."""
    return table.where(F.col(until) > now)


def consume_token(tokens: DataFrame, presented: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(tokens after use, owners admitted): a token works once, before its expiry; the owner's other tokens end with it."""
    good = presented.join(tokens.where(F.col("consumed_at").isNull() & (F.col("expires_at") > now)), "token_hash").select("owner").distinct()
    used = tokens.join(good.withColumn("_used", F.lit(True)), "owner", "left")
    after = used.withColumn("consumed_at", F.when(F.col("_used") & F.col("consumed_at").isNull(), now).otherwise(F.col("consumed_at"))).drop("_used")
    return after, good


def latest_of(children: DataFrame, parent: str, order: list[str], columns: list[str]) -> DataFrame:
    """Per parent the number of children, and columns of the last one by the given order, in one pass."""
    newest = F.max_by(F.struct(*columns), F.struct(*order))
    out = children.groupBy(parent).agg(F.count("*").alias("children"), newest.alias("_last"))
    return out.select(parent, "children", *(F.col(f"_last.{c}").alias(f"latest_{c}") for c in columns))
