"""Tables that several parts of a plan read: computed once, written in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df written once as a table in the folder of spark.checkpoint.dir, which all executors and the driver share, and read
    back: each part reads the columns that it needs, and a lost executor costs no more than the stage at work. The table stays
    for as long as the folder does, as results read it. Only a local session (tests) may go without such a folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or f"/tmp/tickloom-kept-{uuid.uuid4().hex[:8]}")
    path = f"{context.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
