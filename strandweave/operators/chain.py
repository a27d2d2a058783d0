"""The chain of fragment filters, and sets of intervals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.operators import filters, links
from strandweave.plans.iteration import checkpointed


@dataclass(frozen=True)
class Chain:
    """Percent of bases that the longest fragments make up; sites that a fragment must exceed; band of link density, in multiples of the
    mean; quartile ranges that read depth may reach above its third quartile; neighbours of a rank sum, and the largest one."""

    nx: float = 80
    sites: int = 25
    low: float = 0.2
    high: float = 1.9
    depth_times: float = 1.5
    top: int = 5
    rank_sum: int | None = None
    rank_times: float = 1.5


def among(full: DataFrame, kept: DataFrame) -> DataFrame:
    """Links of which both contigs are kept."""
    names = kept.select("ctg")
    both = full.join(names.withColumnRenamed("ctg", "ctg_i"), "ctg_i", "left_semi").join(names.withColumnRenamed("ctg", "ctg_j"), "ctg_j", "left_semi")
    return both.select(*full.columns)


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """The contigs that are in both."""
    return a.select("ctg").join(b.select("ctg"), "ctg", "left_semi").distinct()


def dense_enough(contigs: DataFrame, full: DataFrame, c: Chain) -> DataFrame:
    """Contigs within the band of link density whose read depth (column depth), if there is one, is no outlier.

    The quartiles of the depth are of all given contigs, not of those within the band.
    """
    dens = filters.density(contigs, links.degree(among(full, contigs)))
    band = filters.density_band(dens, c.low, c.high)
    return common(band, filters.below_iqr(contigs, "depth", c.depth_times)) if "depth" in contigs.columns else band.select("ctg")


def at_most(sums: DataFrame, cutoff: int) -> DataFrame:
    return sums.where(F.col("rank_sum") <= cutoff)


def filter_fragments(contigs: DataFrame, full: DataFrame, wanted: DataFrame, c: Chain = Chain(), keep: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(ctg): by length, sites, density and depth, then rank sums, each over what is left; the ``wanted`` come back at the end.

    ``keep`` writes what several later steps read (by default a checkpoint), so that no step repeats those before.
    """
    full = keep(full)
    long = keep(filters.enough_sites(filters.nx(contigs, c.nx), c.sites))
    dense = keep(dense_enough(long, full, c))
    sums = keep(filters.rank_sums(keep(among(full, dense)), dense, c.top))
    kept = at_most(sums, c.rank_sum) if c.rank_sum is not None else filters.below_iqr(sums, "rank_sum", c.rank_times)
    return filters.rescued(kept.select("ctg"), contigs.select("ctg"), wanted)


# --- intervals, half open, by key ---


def interval_union(intervals: DataFrame, key: str) -> DataFrame:
    """(key, start, end): the islands that overlapping or touching intervals make up."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.where(F.col("end") > F.col("start")).withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0)))
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def interval_complement(union: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """(key, start, end): what the islands leave out of 0..size, for each row of (key, size)."""
    edges = sizes.select(key, F.col("size").alias("start"), F.col("size").alias("end")).unionByName(union.select(key, "start", "end"))
    before = F.coalesce(F.max("end").over(Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return edges.select(key, before.alias("start"), F.col("start").alias("end")).where(F.col("end") > F.col("start"))


def interval_difference(intervals: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """(key, start, end): the islands of ``intervals`` without those of ``others``, by a sweep over the ends of both."""
    ends = lambda df, a: df.select(key, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(key, "e.at", (F.col("e.d") if a else F.lit(0)).alias("in_a"), (F.lit(0) if a else F.col("e.d")).alias("in_b"))
    both = ends(interval_union(intervals, key), True).unionByName(ends(interval_union(others, key), False))
    steps = both.groupBy(key, "at").agg(F.sum("in_a").alias("in_a"), F.sum("in_b").alias("in_b"))
    w = Window.partitionBy(key).orderBy("at")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = steps.select(key, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), F.sum("in_a").over(upto).alias("a"), F.sum("in_b").over(upto).alias("b"))
    return interval_union(parts.where("a > 0 and b = 0").select(key, "start", "end"), key)


def interval_hull(intervals: DataFrame, key: str) -> DataFrame:
    return intervals.groupBy(key).agg(F.min("start").alias("start"), F.max("end").alias("end"))
