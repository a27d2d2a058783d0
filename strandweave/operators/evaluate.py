"""Scores of groups, orders and classifiers against a known truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.operators.links import both_ways


def link_types(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """(ctg, same, homolog, other): links with contigs of the same haplotype and group, of the same group only, of others."""
    side = lambda c, s: contigs.select(F.col("ctg").alias(c), F.col("grp").alias(f"g{s}"), F.col("hap").alias(f"h{s}"))
    j = both_ways(links).join(side("ctg", 1), "ctg").join(side("other", 2), "other")
    same_g, same_h = F.col("g1").eqNullSafe(F.col("g2")), F.col("h1").eqNullSafe(F.col("h2"))
    add = lambda c, n: F.sum(F.when(c, F.col("links")).otherwise(0)).alias(n)
    return j.groupBy("ctg").agg(add(same_g & same_h, "same"), add(same_g & ~same_h, "homolog"), add(~same_g, "other"))


def roc(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tpr, fpr) of (score, positive): a row is called if its score is over the threshold."""
    t = F.explode(F.array(*(F.lit(x) for x in thresholds)))
    called, pos = F.col("score") > F.col("threshold"), F.col("positive")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return scored.withColumn("threshold", t).groupBy("threshold").agg((n(called & pos) / n(pos)).alias("tpr"), (n(called & ~pos) / n(~pos)).alias("fpr"))


def agreement(points: DataFrame, key: str) -> DataFrame:
    """(key, pearson, lin_ccc) of (x, y): Lin's concordance with population moments."""
    r = F.corr("x", "y")
    ccc = 2 * r * F.stddev_pop("x") * F.stddev_pop("y") / (F.var_pop("x") + F.var_pop("y") + F.pow(F.avg("x") - F.avg("y"), F.lit(2)))
    return points.groupBy(key).agg(r.alias("pearson"), ccc.alias("lin_ccc"))


def dominance(contigs: DataFrame, group: str, truth: str) -> DataFrame:
    """(group, dominant, len, dominant_len): the truth with most bases of each group; ties to the larger name."""
    per = contigs.groupBy(F.col(group).alias("g"), F.col(truth).alias("t")).agg(F.sum("len").alias("l"))
    return per.groupBy("g").agg(F.max_by("t", F.struct("l", "t")).alias("dominant"), F.sum("l").alias("len"), F.max("l").alias("dominant_len"))


def grouping_errors(contigs: DataFrame) -> DataFrame:
    """(anchored_pct, error_pct): share of bases in groups, and of those not of their group's dominant haplotype."""
    d = dominance(contigs.where("grp is not null"), "grp", "hap").agg(F.sum("len").alias("a"), F.sum("dominant_len").alias("d"))
    total = contigs.agg(F.sum("len").alias("t"))
    return total.crossJoin(F.broadcast(d)).select((100.0 * F.col("a") / F.col("t")).alias("anchored_pct"), (100.0 * (F.col("a") - F.col("d")) / F.col("a")).alias("error_pct"))


def allele_class(a: Column, b: Column) -> Column:
    """Kind of difference of two alleles; '-' is a deletion."""
    purine = lambda x: x.isin("A", "G")
    return F.when(a == b, "Identical").when((a == "-") | (b == "-"), "InDel").when(purine(a) == purine(b), "Transition").otherwise("Transversion")


def distance_classes(breaks: DataFrame, edges: list[int]) -> DataFrame:
    """(label, n) of (distance): counts by half-open classes, the last one open."""
    label = F.lit(f">={edges[-1]}")
    for lo, hi in reversed(list(zip([0, *edges[:-1]], edges, strict=True))):
        label = F.when(F.col("distance") < hi, F.lit(f"{lo}-{hi}")).otherwise(label)
    return breaks.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def excess(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, n): by how much more often a key comes in ``a`` than in ``b``."""
    x, y = a.groupBy(key).agg(F.count("*").alias("na")), b.groupBy(key).agg(F.count("*").alias("nb"))
    d = F.col("na") - F.coalesce("nb", F.lit(0))
    return x.join(y, key, "left").where(d > 0).select(key, d.alias("n"))


def discordant(pairs: DataFrame, truth_ranges: DataFrame) -> DataFrame:
    """(distance, n, low, high) of bins whose number of links lies outside the range of the truth at the same distance."""
    d = pairs.groupBy("i", "j").agg(F.count("*").alias("n")).withColumn("distance", F.col("j") - F.col("i"))
    return d.join(truth_ranges, "distance").where((F.col("n") < F.col("low")) | (F.col("n") > F.col("high"))).select("i", "j", "distance", "n", "low", "high")


def ranges_by_distance(pairs: DataFrame) -> DataFrame:
    d = pairs.groupBy("i", "j").agg(F.count("*").alias("n"))
    return d.groupBy((F.col("j") - F.col("i")).alias("distance")).agg(F.min("n").alias("low"), F.max("n").alias("high"))


def top_dominant(layout: DataFrame, top: int) -> DataFrame:
    """(object, source): the source that most of an object's ``top`` longest contigs come from; smaller objects drop out."""
    w = Window.partitionBy("object").orderBy(F.col("len").desc(), "ctg")
    t = layout.withColumns({"r": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("object"))}).where((F.col("r") <= top) & (F.col("n") >= top))
    per = t.groupBy("object", "source").agg(F.count("*").alias("c"))
    return per.groupBy("object").agg(F.max_by("source", F.struct("c", "source")).alias("source"))
