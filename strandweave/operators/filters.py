"""Filters of fragments by length, density, depth and rank sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.operators.links import both_ways
from strandweave.plans.iteration import checkpointed


def tie(name: Column) -> Column:
    """A fixed pseudo-random order of names of equal length."""
    return F.md5(name.cast("binary"))


def nx(contigs: DataFrame, percent: float) -> DataFrame:
    """Longest first, as long as what stands before a contig is under ``percent`` of all bases; all at 100.

    Lengths are first summed by length, so only one row for each length is ordered in one place; contigs of one length
    follow in the order of their tie-break.
    """
    if percent >= 100:
        return contigs
    total = contigs.agg(F.sum("len").alias("total"))
    per = contigs.groupBy("len").agg(F.count("*").alias("c"))
    w = Window.orderBy(F.col("len").desc()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("len").alias("l"), F.coalesce(F.sum(F.col("len") * F.col("c")).over(w), F.lit(0)).alias("ahead"))
    n = F.row_number().over(Window.partitionBy("len").orderBy(tie(F.col("ctg")), "ctg"))
    ranked = contigs.withColumn("n", n).join(per, F.col("len") == F.col("l")).crossJoin(F.broadcast(total))  # total is one row
    return ranked.where((F.col("ahead") + (F.col("n") - 1) * F.col("len")) * 100 < F.col("total") * percent).select(*contigs.columns)


def rescued(kept: DataFrame, contigs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``kept`` and the contigs of a list of names, once each."""
    return kept.unionByName(contigs.join(wanted.select("ctg"), "ctg", "left_semi").select(*kept.columns)).distinct()


def enough_sites(contigs: DataFrame, cutoff: int) -> DataFrame:
    return contigs.where(F.col("re_sites") > cutoff)


def density(contigs: DataFrame, degree: DataFrame) -> DataFrame:
    """(ctg, density): links by restriction sites, 0 without links."""
    return contigs.join(degree, "ctg", "left").select("ctg", "re_sites", F.coalesce("degree", F.lit(0)).alias("degree")).withColumn("density", F.col("degree") / F.col("re_sites"))


def density_band(dens: DataFrame, low: float, high: float) -> DataFrame:
    """Between ``low`` and ``high`` times the average: all links over all sites (one pseudo-count) of linked contigs."""
    linked = dens.where("degree > 0").agg((F.sum("degree") / (1 + F.sum(F.col("re_sites") - 1))).alias("mean"))
    return dens.crossJoin(F.broadcast(linked)).where((F.col("density") >= low * F.col("mean")) & (F.col("density") <= high * F.col("mean"))).select("ctg", "density")


def density_slice(dens: DataFrame, low: float, high: float) -> DataFrame:
    """The rows from int(n*low) to int(n*high) in order of density; ranks come from counts by density."""
    per = dens.groupBy("density").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy("density").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(F.col("density").alias("d"), before.alias("before"))
    n = dens.agg(F.count("*").alias("n"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("density").orderBy("ctg")) - 1
    out = dens.join(per, F.col("density") == F.col("d")).crossJoin(F.broadcast(n)).withColumn("at", at)
    return out.where((F.col("at") >= F.floor(F.col("n") * low)) & (F.col("at") < F.floor(F.col("n") * high))).select("ctg", "density")


def below_iqr(frame: DataFrame, column: str, times: float) -> DataFrame:
    """Rows up to the third quartile plus ``times`` the interquartile range (exact, linear quantiles)."""
    q = frame.agg(F.expr(f"percentile({column}, array(0.25, 0.75))").alias("q"))
    return frame.crossJoin(F.broadcast(q)).where(F.col(column) <= F.col("q")[1] + times * (F.col("q")[1] - F.col("q")[0])).drop("q")


def rank_sums(links: DataFrame, names: DataFrame, top: int) -> DataFrame:
    """(ctg, rank_sum): over all pairs of a contig's ``top`` neighbours, the smaller of the ranks they give each other.

    A contig ranks every other name, by links (0 if none) falling, then name; from 0. Linked names have their place among
    the links; names without links follow by counting (all links, then the unlinked names before), so the n*(n-1) ranks
    are never written out. Only the names themselves are numbered in one place.
    """
    names = names.select("ctg").distinct()
    place = names.select(F.col("ctg").alias("other"), (F.row_number().over(Window.orderBy("ctg")) - 1).alias("place"))
    known = both_ways(links).where("ctg <> other").join(names, "ctg", "left_semi").join(names.withColumnRenamed("ctg", "other"), "other", "left_semi")
    w = Window.partitionBy("ctg").orderBy(F.col("links").desc(), "other")
    linked = known.where("links > 0").select("ctg", "other", (F.row_number().over(w) - 1).alias("rank"))
    degree = names.join(known.where("links > 0").groupBy("ctg").agg(F.count("*").alias("n")), "ctg", "left").select("ctg", F.coalesce("n", F.lit(0)).alias("n"))
    # a contig with fewer links than top goes on with names in their order: under 2 * top of them hold enough that are neither linked nor its own
    few = F.broadcast(place.where(F.col("place") < 2 * top).select("other"))
    spare = degree.where(F.col("n") < top).join(few, F.col("ctg") != F.col("other")).join(known.where("links > 0").select("ctg", "other"), ["ctg", "other"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("ctg").orderBy("other")) - 1
    near = checkpointed(linked.where(F.col("rank") < top).select("ctg", "other").union(spare.withColumn("at", F.col("n") + nth).where(F.col("at") < top).select("ctg", "other")))
    duo = near.select("ctg", F.col("other").alias("a")).join(near.select("ctg", F.col("other").alias("b")), "ctg").where(F.col("a") < F.col("b"))
    pairs = duo.select("a", "b").distinct()
    asked = pairs.select(F.col("a").alias("ctg"), F.col("b").alias("other")).union(pairs.select(F.col("b"), F.col("a")))
    row = linked.select("ctg", "other", "rank", F.lit(1).alias("known")).unionByName(asked.select("ctg", "other", F.lit(None).cast("int").alias("rank"), F.lit(0).alias("known")))
    upto = Window.partitionBy("ctg").orderBy("other").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = row.withColumn("before", F.sum("known").over(upto)).withColumn("own", F.max("rank").over(Window.partitionBy("ctg", "other"))).where("known = 0")
    placed = met.join(place, "other").join(degree, "ctg")
    unlinked = F.col("n") + F.col("place") - (F.col("ctg") < F.col("other")).cast("long") - F.col("before")
    rank = placed.select("ctg", "other", F.coalesce("own", unlinked).alias("rank"))
    rank = checkpointed(rank)
    ab = rank.select(F.col("ctg").alias("a"), F.col("other").alias("b"), F.col("rank").alias("rab"))
    ba = rank.select(F.col("ctg").alias("b"), F.col("other").alias("a"), F.col("rank").alias("rba"))
    return duo.join(ab, ["a", "b"]).join(ba, ["a", "b"]).groupBy("ctg").agg(F.sum(F.least("rab", "rba")).alias("rank_sum"))


def concordant(ratios: DataFrame, cutoff: float) -> DataFrame:
    """Pairs of contigs that look allelic."""
    return ratios.where(F.col("ratio") > cutoff)
