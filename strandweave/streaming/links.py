"""Link counts over read pairs that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandweave.operators import pairs as P

PAIRS = "read_id string, ref string, pos long, mref string, mpos long"


def running_links(pairs: DataFrame) -> DataFrame:
    """(ctg_i, ctg_j, links) of a stream of raw pairs, for update or complete mode; the state is a count for each pair of contigs."""
    return P.between_contigs(P.canonical(pairs)).groupBy("ctg_i", "ctg_j").agg(F.count("*").alias("links"))


def windowed_links(pairs: DataFrame, late: str, window: str) -> DataFrame:
    """Counts by arrival window; ``pairs`` has a column ts as well, rows over ``late`` behind are dropped."""
    p = pairs.withWatermark("ts", late)
    here, there = F.struct("ref", "pos"), F.struct("mref", "mpos")
    lo, hi = F.when(here <= there, F.col("ref")).otherwise(F.col("mref")), F.when(here <= there, F.col("mref")).otherwise(F.col("ref"))
    return p.where("ref <> mref").groupBy(F.window("ts", window), lo.alias("ctg_i"), hi.alias("ctg_j")).agg(F.count("*").alias("links"))


def from_folder(spark: SparkSession, path: str) -> DataFrame:
    """Read pairs of Parquet files that appear in a folder."""
    return spark.readStream.schema(PAIRS).parquet(path)


def to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs over what is there and stops; the result is a table of that name."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
