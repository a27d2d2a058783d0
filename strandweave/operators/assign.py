"""Groups of contigs: sums, links to groups, best groups, gates, votes and curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.operators.links import both_ways


def group_totals(contigs: DataFrame) -> DataFrame:
    """(grp, n, len, re_sum): sites with a single pseudo-count."""
    return contigs.where("grp is not null").groupBy("grp").agg(F.count("*").alias("n"), F.sum("len").alias("len"), (1 + F.sum(F.col("re_sites") - 1)).alias("re_sum"))


def large_groups(totals: DataFrame, least: int) -> DataFrame:
    return totals.where(F.col("len") >= least)


def ungrouped(contigs: DataFrame, assigned: DataFrame) -> DataFrame:
    return contigs.select("ctg").join(assigned.where("grp is not null").select("ctg"), "ctg", "left_anti")


def links_to_groups(links: DataFrame, contigs: DataFrame) -> DataFrame:
    """(ctg, grp, links): links of each contig with the members of each group."""
    member = contigs.where("grp is not null").select(F.col("ctg").alias("other"), "grp")
    return both_ways(links).join(member, "other").groupBy("ctg", "grp").agg(F.sum("links").alias("links"))


def link_densities(to_groups: DataFrame, contigs: DataFrame, totals: DataFrame) -> DataFrame:
    """(ctg, grp, links, density): per site of the group, which counts the contig's own sites whether it is in or not."""
    own = contigs.select("ctg", F.col("grp").alias("own"), "re_sites")
    d = to_groups.join(own, "ctg").join(totals.select("grp", "re_sum"), "grp")
    sites = F.when(F.col("own").eqNullSafe(F.col("grp")), F.col("re_sum")).otherwise(F.col("re_sum") + F.col("re_sites") - 1)
    return d.select("ctg", "own", "re_sites", "grp", "links", (F.col("links") / sites).alias("density"))


def best_two(dens: DataFrame) -> DataFrame:
    """One row a contig: best group, links with the best and second one, best density, and mean density of the other groups."""
    w = Window.partitionBy("ctg").orderBy(F.col("links").desc(), "grp")
    r = dens.withColumn("rank", F.row_number().over(w))
    at = lambda k, c: F.max(F.when(F.col("rank") == k, F.col(c)))
    g = r.groupBy("ctg").agg(
        F.first("own").alias("own"), F.first("re_sites").alias("re_sites"), at(1, "grp").alias("best"), at(1, "links").alias("best_links"), F.coalesce(at(2, "links"), F.lit(0)).alias("second_links"),
        at(1, "density").alias("best_density"), F.sum("density").alias("all_density"), F.count("*").alias("n_groups"),
    )
    others = F.when(F.col("n_groups") > 1, (F.col("all_density") - F.col("best_density")) / (F.col("n_groups") - 1))
    return g.select("ctg", "own", "re_sites", "best", "best_links", "second_links", "best_density", others.alias("other_density"))


def gate(best: DataFrame, sites: int, links: int, ambiguous: float, density: float, ratio: float) -> DataFrame:
    """(ctg, status): the first gate that a contig fails, in order, else whether it stays, moves or is rescued."""
    r = F.col("second_links") / F.col("best_links")
    status = (
        F.when(F.col("re_sites") < sites, "few_sites").when(F.col("best_links") < links, "few_links").when(r >= ambiguous, "ambiguous").when(F.col("best_density") < density, "low_density")
        .when(F.col("other_density").isNull() | (F.col("best_density") < ratio * F.col("other_density")), "low_ratio")
        .when(F.col("own").isNull(), "rescued").when(F.col("own") != F.col("best"), "moved").otherwise("stays")
    )
    return best.select("ctg", status.alias("status"))


def status_counts(gated: DataFrame) -> DataFrame:
    return gated.groupBy("status").agg(F.count("*").alias("n"))


def group_pairs(links: DataFrame, contigs: DataFrame, totals: DataFrame) -> DataFrame:
    """(grp_a, grp_b, links, density): links between groups, per product of their sites."""
    side = lambda s: contigs.where("grp is not null").select(F.col("ctg").alias(f"ctg_{s}"), F.col("grp").alias(f"g_{s}"))
    j = links.join(side("i"), "ctg_i").join(side("j"), "ctg_j").where(F.col("g_i") != F.col("g_j"))
    g = j.groupBy(F.least("g_i", "g_j").alias("grp_a"), F.greatest("g_i", "g_j").alias("grp_b")).agg(F.sum("links").alias("links"))
    size = lambda s: totals.select(F.col("grp").alias(f"grp_{s}"), F.col("re_sum").alias(f"re_{s}"))
    return g.join(size("a"), "grp_a").join(size("b"), "grp_b").select("grp_a", "grp_b", "links", (F.col("links") / (F.col("re_a") * F.col("re_b"))).alias("density"))


def bin_vote(bins: DataFrame) -> DataFrame:
    """(ctg, cluster): where most length of a contig's bins went; ties to the smaller cluster."""
    w = Window.partitionBy("ctg").orderBy(F.col("len").desc(), "cluster")
    return bins.groupBy("ctg", "cluster").agg(F.sum("len").alias("len")).withColumn("r", F.row_number().over(w)).where("r = 1").select("ctg", "cluster")


def main_groups(groups: DataFrame, key: str, ratio: float) -> DataFrame:
    """(key, main): groups, longest first, before the first drop to under ``ratio`` of the one before; all if there is none."""
    w = Window.partitionBy(key).orderBy(F.col("len").desc(), "grp")
    r = groups.withColumn("rank", F.row_number().over(w)).withColumn("next", F.lead("len").over(w))
    drop = F.min(F.when(F.col("next") / F.col("len") < ratio, F.col("rank")))
    return r.groupBy(key).agg(F.coalesce(drop, F.count("*")).cast("long").alias("main"))


def recommended(groups: DataFrame, key: str, wanted: int, ratios: tuple[float, ...]) -> DataFrame:
    """(ratio, key): the smallest key with enough main groups, at the first of the ratios for which there is one."""
    found = None
    for k, r in enumerate(ratios):
        one = main_groups(groups, key, r).where(F.col("main") >= wanted).agg(F.min(key).alias(key)).select(F.lit(k).alias("k"), F.lit(r).alias("ratio"), key).where(F.col(key).isNotNull())
        found = one if found is None else found.unionByName(one)
    return found.orderBy("k").limit(1).select("ratio", key)


def curve(values: DataFrame, column: str) -> DataFrame:
    """(value, pct_filtered, pct_length_left): shares of contigs at or under a value, and of length above it, for each distinct value."""
    per = values.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"), F.sum("len").alias("l"))
    all_ = per.agg(F.sum("c").alias("cc"), F.sum("l").alias("ll"))
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)  # one row for each distinct value
    return per.crossJoin(F.broadcast(all_)).select("value", (100.0 * F.sum("c").over(w) / F.col("cc")).alias("pct_filtered"), (100.0 * (F.col("ll") - F.sum("l").over(w)) / F.col("ll")).alias("pct_length_left"))
