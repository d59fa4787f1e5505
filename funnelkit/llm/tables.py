"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from funnelkit.session import checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet beside the session's checkpoints and read back. Like a
    checkpoint it cuts the lineage; unlike one its size is known when a join with it is
    planned, so Spark broadcasts it below the session's threshold, without shuffling the
    other side, and joins by key above it."""
    checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
