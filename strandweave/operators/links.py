"""Link counts between contigs, their halves and bins, and what is computed from the coordinates of a pair of contigs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.operators import pairs as P


def full_links(pairs: DataFrame) -> DataFrame:
    return P.between_contigs(pairs).groupBy("ctg_i", "ctg_j").agg(F.count("*").alias("links"))


def flank_links(pairs: DataFrame, contigs: DataFrame, flank: int) -> DataFrame:
    """Links whose both ends are near the ends of their contigs."""
    p = P.with_lengths(P.between_contigs(pairs), contigs)
    near = P.in_flank(F.col("pos_i"), F.col("len_i"), flank) & P.in_flank(F.col("pos_j"), F.col("len_j"), flank)
    return p.where(near).groupBy("ctg_i", "ctg_j").agg(F.count("*").alias("links"))


def both_ways(links: DataFrame, value: str = "links") -> DataFrame:
    """(ctg, other, value) with each edge in both directions."""
    ends = F.array(F.struct(F.col("ctg_i").alias("ctg"), F.col("ctg_j").alias("other")), F.struct(F.col("ctg_j").alias("ctg"), F.col("ctg_i").alias("other")))
    return links.select(F.explode(ends).alias("e"), value).select("e.ctg", "e.other", value)


def degree(links: DataFrame) -> DataFrame:
    return both_ways(links).groupBy("ctg").agg(F.sum("links").alias("degree"))


def half_links(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    p = P.with_lengths(P.between_contigs(pairs), contigs)
    keys = ["ctg_i", P.half(F.col("pos_i"), F.col("len_i")).alias("half_i"), "ctg_j", P.half(F.col("pos_j"), F.col("len_j")).alias("half_j")]
    return p.groupBy(*keys).agg(F.count("*").alias("links"))


ORIENTATIONS = (("+", "+", "d_pp"), ("+", "-", "d_pm"), ("-", "+", "d_mp"), ("-", "-", "d_mm"))


def orientation_distances(pairs: DataFrame, contigs: DataFrame, least: int = 2) -> DataFrame:
    """(ctg_i, ori_i, ctg_j, ori_j, links, distances): sorted distances of each orientation, for pairs with enough links."""
    p = P.distances(P.with_lengths(P.between_contigs(pairs), contigs))
    lists = [F.sort_array(F.collect_list(d)).alias(d) for _, _, d in ORIENTATIONS]
    g = p.groupBy("ctg_i", "ctg_j").agg(F.count("*").alias("links"), *lists).where(F.col("links") >= least)
    rows = F.array(*(F.struct(F.lit(a).alias("ori_i"), F.lit(b).alias("ori_j"), F.col(d).alias("distances")) for a, b, d in ORIENTATIONS))
    return g.select("ctg_i", "ctg_j", "links", F.explode(rows).alias("o")).select("ctg_i", "o.ori_i", "ctg_j", "o.ori_j", "links", "o.distances")


def first_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The first ``k`` pairs of each two contigs, in order of read and positions."""
    w = Window.partitionBy("ctg_i", "ctg_j").orderBy("read_id", "pos_i", "pos_j")
    return P.between_contigs(pairs).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def concordance(pairs: DataFrame, contigs: DataFrame, windows: int, least: int) -> DataFrame:
    """(ctg_i, ctg_j, n, ratio): share of the commonest diagonal (or antidiagonal) strip; a strip is the shorter contig over ``windows`` wide."""
    p = P.with_lengths(P.between_contigs(pairs), contigs)
    w = F.floor(F.least("len_i", "len_j") / windows)
    p = p.where(w > 0).repartition("ctg_i", "ctg_j")  # all counts below are within two contigs
    strip = lambda v: F.floor(v / w)
    kinds = F.array(F.struct(F.lit("d").alias("k"), strip(F.col("pos_j") - F.col("pos_i")).alias("s")), F.struct(F.lit("a").alias("k"), strip(F.col("pos_j") + F.col("pos_i")).alias("s")))
    counts = p.select("ctg_i", "ctg_j", F.explode(kinds).alias("e")).groupBy("ctg_i", "ctg_j", "e.k", "e.s").agg(F.count("*").alias("c"))
    best = counts.groupBy("ctg_i", "ctg_j").agg((F.sum("c") / 2).cast("long").alias("n"), F.max("c").alias("top"))
    return best.where(F.col("n") >= least).select("ctg_i", "ctg_j", "n", (F.col("top") / F.col("n")).alias("ratio"))


def concentration(pairs: DataFrame, bin_size: int, times: float) -> DataFrame:
    """(ctg_i, ctg_j, adj): (1-rx)(1-ry), r the share of links in bins with ``times`` the median of the bins in use, on either contig."""
    p = P.between_contigs(pairs).select("ctg_i", "ctg_j", "pos_i", "pos_j").repartition("ctg_i", "ctg_j")  # all counts below are within two contigs
    sides = F.array(F.struct(F.lit("x").alias("side"), F.floor(F.col("pos_i") / bin_size).alias("bin")), F.struct(F.lit("y").alias("side"), F.floor(F.col("pos_j") / bin_size).alias("bin")))
    bins = p.select("ctg_i", "ctg_j", F.explode(sides).alias("e")).groupBy("ctg_i", "ctg_j", F.col("e.side").alias("side"), F.col("e.bin").alias("bin")).agg(F.count("*").alias("c"))
    same = bins.groupBy("ctg_i", "ctg_j", "side", "c").agg((F.count("*")).alias("bins"))  # a row for each distinct count
    counts = same.groupBy("ctg_i", "ctg_j", "side").agg(F.expr("percentile(c, 0.5, bins)").alias("m"), F.sum(F.col("c") * F.col("bins")).alias("n"), F.collect_list(F.struct("c", "bins")).alias("all"))
    hot = F.aggregate(F.filter("all", lambda x: x["c"] >= times * F.col("m")), F.lit(0).cast("long"), lambda t, x: t + x["c"] * x["bins"])
    r = counts.select("ctg_i", "ctg_j", "side", (hot / F.col("n")).alias("r"))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("r")))
    return r.groupBy("ctg_i", "ctg_j").agg(((1 - side("x")) * (1 - side("y"))).alias("adj"))


def damp_haplotypes(links: DataFrame, contigs: DataFrame, weight: float) -> DataFrame:
    """Links between different haplotypes lose ``weight`` of themselves; what falls to nothing goes."""
    hap = lambda s: contigs.select(F.col("ctg").alias(f"ctg_{s}"), F.col("hap").alias(f"hap_{s}"))
    w = F.when(F.col("hap_i") != F.col("hap_j"), F.col("links") * (1 - weight)).otherwise(F.col("links").cast("double"))
    return links.join(hap("i"), "ctg_i").join(hap("j"), "ctg_j").select("ctg_i", "ctg_j", w.alias("links")).where(F.col("links") != 0)


def geometric_normalised(links: DataFrame, rescale: bool = False) -> DataFrame:
    """w / sqrt(degree_i * degree_j); with ``rescale``, times what keeps the sum of all weights."""
    d = degree(links)
    side = lambda s: d.select(F.col("ctg").alias(f"ctg_{s}"), F.col("degree").alias(f"d_{s}"))
    out = links.join(side("i"), "ctg_i").join(side("j"), "ctg_j").withColumn("w", F.col("links") / F.sqrt(F.col("d_i") * F.col("d_j")))
    if rescale:
        total = out.agg((F.sum("links") / F.sum("w")).alias("f"))
        out = out.crossJoin(F.broadcast(total)).withColumn("w", F.col("w") * F.col("f"))  # total is one row
    return out.select("ctg_i", "ctg_j", "w")


def length_normalised(links: DataFrame, contigs: DataFrame, flank: int) -> DataFrame:
    side = lambda s: contigs.select(F.col("ctg").alias(f"ctg_{s}"), F.least("len", F.lit(2 * flank)).alias(f"l_{s}"))
    return links.join(side("i"), "ctg_i").join(side("j"), "ctg_j").select("ctg_i", "ctg_j", (F.col("links") / (F.col("l_i") * F.col("l_j") / 1e12)).alias("w"))


def boosted(links: DataFrame, favoured: DataFrame, times: float) -> DataFrame:
    """Links of the (ctg_i, ctg_j) in ``favoured`` count ``times`` as much."""
    f = favoured.select("ctg_i", "ctg_j").distinct().withColumn("hit", F.lit(True))
    return links.join(f, ["ctg_i", "ctg_j"], "left").select("ctg_i", "ctg_j", F.when(F.col("hit"), F.col("links") * times).otherwise(F.col("links")).alias("links"))


def symmetric(links: DataFrame, nodes: DataFrame, loops: bool) -> DataFrame:
    """(i, j, v): both directions of each edge, and a unit loop for each node if asked for."""
    out = both_ways(links).select(F.col("ctg").alias("i"), F.col("other").alias("j"), F.col("links").cast("double").alias("v"))
    return out.unionByName(nodes.select(F.col("ctg").alias("i"), F.col("ctg").alias("j"), F.lit(1.0).alias("v"))) if loops else out


def without_pairs(links: DataFrame, removed: DataFrame) -> DataFrame:
    return links.join(removed.select("ctg_i", "ctg_j"), ["ctg_i", "ctg_j"], "left_anti")


def isolated(contigs: DataFrame, links: DataFrame) -> DataFrame:
    """Contigs without any link."""
    return contigs.select("ctg").join(both_ways(links).select("ctg"), "ctg", "left_anti")
