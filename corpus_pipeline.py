"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyplan.llm import common
from tallyplan.llm.decontaminate import keep_uncontaminated
from tallyplan.llm.packing import pack_stage
from tallyplan.llm.pii import redact
from tallyplan.llm.quality_classifier import keep_quality
from tallyplan.llm.simhash import keep_firsts

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", keep_firsts),
    ("benchmark_decontamination", keep_uncontaminated),
    ("pii", redact),
    ("packing", pack_stage),
]

#: No stage but the fourth could be put into SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents and returns the packed pieces."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
