"""Snapshots, label maps and manifests: JSON in and out with explicit schemas, and template images as binary files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOX = "symbolName string, symbol_name string, x int, y int, width int, height int, match double, verification double, coverage double, purity double, context_purity double, rotation int, scale double, mirrored boolean, source string, roiStrategy string"
SNAPSHOT = f"name string, kind string, analysisId string, boxes array<struct<{BOX.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' boolean', ':boolean')}>>, performance struct<backendTimingsMs:map<string,double>,backendCounters:map<string,bigint>>, _corrupt string"
MANIFEST = "name string, enabled boolean, expectedProfile string, detectorProfile string, golden string, templateCount int, focus string, centerTolerance double, sizeTolerance double, excludedZones array<struct<x:int,y:int,width:int,height:int>>"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Snapshot files, one JSON document each; one that can't be read has nothing but its text in ``_corrupt``."""
    return spark.read.schema(SNAPSHOT).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def boxes_of(snapshots: DataFrame) -> DataFrame:
    """A row per box, with the symbol under either of its two names."""
    one = snapshots.select("name", F.posexplode("boxes").alias("ordinal", "b"))
    return one.select("name", "ordinal", F.coalesce("b.symbolName", "b.symbol_name").alias("symbol"), "b.x", "b.y", F.col("b.width").alias("w"), F.col("b.height").alias("h"), "b.match", "b.verification", "b.source")


def slowest_stages(snapshots: DataFrame, k: int = 8) -> DataFrame:
    """The k stages that took longest in each snapshot; totals are no stages."""
    from pyspark.sql import Window

    rows = snapshots.select("name", F.explode("performance.backendTimingsMs").alias("stage", "ms")).where(~F.lower("stage").contains("total"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ms"), "stage"))).where(F.col("place") <= k)


def newest_files(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The n newest files of each folder."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"))
    return files.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("modificationTime"), "path"))).where(F.col("place") <= n)


def read_manifests(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    out = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    return out.where(F.col("name").isin(names)) if names else out


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    snapshots.drop("_corrupt").write.mode("errorifexists").json(path)


def label_map(text: Column) -> Column:
    """A JSON object of labels as a map; blanks are left out, later keys win."""
    return F.map_filter(F.from_json(text, T.MapType(T.StringType(), T.StringType())), lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != "")


def label_json(labels: Column) -> Column:
    """A map of labels as a JSON object with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Template images as (name, prefix, size, payload), the payload base64-coded."""
    from tallyplan.functions.text import numeric_prefix

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    name = F.regexp_extract("path", r"([^/]*)\.png$", 1)
    return files.select(name.alias("name"), numeric_prefix(name).alias("prefix"), F.col("length").alias("size"), F.base64("content").alias("payload"))


def append_names(existing: DataFrame, drafts: DataFrame) -> DataFrame:
    """Names ``NN_label`` for drafts(ordinal, label), numbered on from the highest prefix; no name is used twice."""
    from pyspark.sql import Window

    from tallyplan.functions.text import file_fragment, numeric_prefix

    top = existing.agg(F.coalesce(F.max(numeric_prefix(F.col("name"))), F.lit(0)).alias("top"))  # one row
    ranked = drafts.withColumn("k", F.row_number().over(Window.orderBy("ordinal", "label")))  # a legend's rows
    return ranked.crossJoin(top).select("ordinal", "label", F.concat(F.lpad((F.col("top") + F.col("k")).cast("string"), 2, "0"), F.lit("_"), file_fragment(F.col("label"))).alias("name"))
