"""Cutting the lineage of iterated plans."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql.functions import broadcast


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; a temporary one only where none is set (tests)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="strandweave-"))
    return df.checkpoint()


def sent(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A checkpoint that joins send to every task, as long as it has at most ``most`` rows."""
    kept = checkpointed(df)
    return broadcast(kept) if kept.count() <= most else kept
