"""Counting: boxes by symbol, symbols by label, totals, and the counters of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyplan.functions.text import label_key


def count_by_symbol(boxes: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """(symbol, n, color, ordinal) of boxes(symbol, color, ordinal); blank symbols don't count. Pre-aggregated
    results(symbol, n, color, ordinal) are used only if there is no box; negative counts are 0. The first colour wins."""
    named = boxes.withColumn("symbol", F.trim("symbol")).where("symbol <> ''")
    color = F.min_by("color", F.when(F.col("color").isNotNull(), F.col("ordinal")))
    counted = named.groupBy("symbol").agg(F.count("*").alias("n"), color.alias("color"), F.min("ordinal").alias("ordinal"))
    if results is None:
        return counted
    given = results.withColumn("symbol", F.trim("symbol")).where("symbol <> ''")
    summed = given.groupBy("symbol").agg(F.sum(F.greatest(F.lit(0), "n")).alias("n"), color.alias("color"), F.min("ordinal").alias("ordinal"))
    any_box = boxes.limit(1).select(F.lit(True).alias("any_box"))  # one row
    return counted.unionByName(summed.join(any_box, F.lit(True), "left_anti"))


def roll_up(counts: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, n, symbols) over symbols whose labels agree but for case and spaces; the first symbol's label is shown.
    A symbol without a label shows its own name."""
    named = counts.where("n > 0").join(labels, "symbol", "left").withColumn("label", F.coalesce("label", "symbol"))
    rolled = named.groupBy(label_key(F.col("label")).alias("key")).agg(
        F.min_by("label", F.struct("ordinal", "symbol")).alias("label"), F.sum("n").alias("n"), F.array_sort(F.collect_set(F.struct("ordinal", "symbol"))).alias("s"), F.min("ordinal").alias("ordinal")
    )
    return rolled.select("label", "n", F.transform("s", lambda x: x["symbol"]).alias("symbols"), "ordinal")


def with_total(rows: DataFrame, label: str = "TOTAL") -> DataFrame:
    """Rows (label, n) and their sum, by one rollup."""
    out = rows.rollup("label").agg(F.sum("n").alias("n"), F.grouping("label").alias("g"))
    return out.select(F.when(F.col("g") == 1, label).otherwise(F.col("label")).alias("label"), F.coalesce("n", F.lit(0)).alias("n"), (F.col("g") == 1).alias("is_total"))


def subtract_legend(detections: DataFrame, subtract: Column) -> DataFrame:
    """Detections per template and how many are reported: one less where the legend's own symbol was found too."""
    return detections.groupBy("template_id").agg(F.count("*").alias("n"), F.max(subtract).alias("subtract")).select("template_id", "n", F.greatest(F.lit(0), F.col("n") - F.col("subtract").cast("int")).alias("reported"))


def grouped_profile(rows: DataFrame, sets: list[list[str]], measures: dict[str, Column]) -> DataFrame:
    """Measures over several groupings in one pass; columns outside a grouping are null, ``level`` tells which it is."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*(m.alias(k) for k, m in measures.items()), F.grouping_id().alias("level"))
    return out
