"""Cutting lineage in loops."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def _shared(df: DataFrame) -> str:
    """The folder that spark.checkpoint.dir names; where the session names none, a local session gets one of its own and a
    cluster is told to name one."""
    context = df.sparkSession.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    import tempfile

    named = context.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='tallyplan-')}")
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """An eager checkpoint in the shared folder."""
    _shared(df)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """A compressed table in the shared folder: smaller than a checkpoint, and a reader of some columns reads no others, but it
    doesn't keep how rows are dealt out."""
    path = f"{_shared(df)}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
