"""Long-read alignments: which of them join two contigs; references of groups; tracks of links by haplotype."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def near_an_end(alignments: DataFrame, mapq: int, least_len: int, most: int) -> DataFrame:
    """Alignments of enough quality, on a contig that is long enough, at most so far from one of its ends."""
    near = F.least(F.col("rstart"), F.col("rlen") - F.col("rend")) <= most
    return alignments.where((F.col("mapq") >= mapq) & (F.col("rlen") >= least_len) & near)


def best_supplementary(alignments: DataFrame) -> DataFrame:
    """The supplementary alignment of each read with the highest score; ties to the smallest line."""
    own = alignments.where("supplementary")
    best = own.groupBy("read").agg(F.max_by(F.struct(*own.columns), F.struct("score", -F.col("line"))).alias("best"))
    return best.select("best.*")


def joins(primary: DataFrame, supplementary: DataFrame, most_overlap: float, most_gap: int) -> DataFrame:
    """(read, ctg_i, ctg_j, overlap): reads whose two alignments overlap little on the read, or leave a small gap."""
    a = primary.select("read", F.col("rname").alias("ctg_i"), F.col("qstart").alias("s1"), F.col("qend").alias("e1"))
    b = supplementary.select("read", F.col("rname").alias("ctg_j"), F.col("qstart").alias("s2"), F.col("qend").alias("e2"))
    overlap = F.least("e1", "e2") - F.greatest("s1", "s2")  # negative: a gap
    shorter = F.least(F.col("e1") - F.col("s1"), F.col("e2") - F.col("s2"))
    fits = F.when(overlap >= 0, overlap <= most_overlap * shorter).otherwise(-overlap <= most_gap)
    return a.join(b, "read").where((F.col("ctg_i") != F.col("ctg_j")) & fits).select("read", "ctg_i", "ctg_j", overlap.alias("overlap"))


def without_reads(rows: DataFrame, names: DataFrame) -> DataFrame:
    return rows.join(names, "read_id", "left_anti").select(*rows.columns)


def unaligned_groups(groups: DataFrame, alignments: DataFrame) -> DataFrame:
    """(grp): groups of which no contig has an alignment."""
    found = groups.join(alignments.select(F.col("qname").alias("ctg")), "ctg", "left_semi").select("grp")
    return groups.select("grp").distinct().join(found, "grp", "left_anti")


def require_alignments(groups: DataFrame, alignments: DataFrame) -> DataFrame:
    """``groups``; reading it fails with the name of a group that has no alignment."""
    missing = unaligned_groups(groups, alignments).withColumn("missing", F.lit(True))
    failed = F.raise_error(F.concat(F.lit("no alignment for group "), F.col("grp").cast("string")))
    return groups.join(missing, "grp", "left").where(F.when(F.col("missing"), failed.cast("boolean")).otherwise(F.lit(True))).select(*groups.columns)


def enough_contigs(groups: DataFrame, least: int) -> DataFrame:
    """``groups`` (grp, ctg, len) without groups of a single contig under ``least`` bases."""
    w = Window.partitionBy("grp")
    marked = groups.withColumns({"n_": F.count("*").over(w), "size_": F.sum("len").over(w)})
    return marked.where((F.col("n_") > 1) | (F.col("size_") >= least)).select(*groups.columns)


def reference_order(lengths: DataFrame) -> DataFrame:
    """(grp, rname, len, idx): groups by the reference that most of their bases align to, within it by these bases, longest first."""
    best = lengths.groupBy("grp").agg(F.max_by(F.struct("rname", "len"), F.struct("len", "rname")).alias("b")).select("grp", "b.rname", "b.len")
    order = Window.partitionBy("rname").orderBy(F.desc("len"), "grp")
    return best.withColumn("idx", F.row_number().over(order).cast("long"))


def haplotype_tracks(pairs: DataFrame, contigs: DataFrame, bin_size: int) -> DataFrame:
    """(ctg, bin, hap, n, upto): links of each bin by the haplotype of the other contig, and their stacked shares."""
    ends = F.array(*(F.struct(F.col(f"ctg_{a}").alias("ctg"), F.col(f"pos_{a}").alias("pos"), F.col(f"ctg_{b}").alias("other")) for a, b in ("ij", "ji")))
    rows = pairs.where("ctg_i <> ctg_j").select(F.explode(ends).alias("e")).select("e.*")
    haps = contigs.select(F.col("ctg").alias("other"), "hap")
    n = rows.join(haps, "other").groupBy("ctg", F.floor(F.col("pos") / bin_size).alias("bin"), "hap").agg(F.count("*").alias("n"))
    w = Window.partitionBy("ctg", "bin")
    upto = F.sum("n").over(w.orderBy("hap").rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("n").over(w)
    return n.withColumn("upto", upto)


def multiplied(full: DataFrame, ratios: DataFrame, cutoff: float, times: float) -> DataFrame:
    """(ctg_i, ctg_j, links): links of pairs with a ratio over the cutoff count ``times`` as much."""
    r = ratios.select("ctg_i", "ctg_j", "ratio")
    return full.join(r, ["ctg_i", "ctg_j"], "left").select("ctg_i", "ctg_j", (F.col("links") * F.when(F.col("ratio") > cutoff, times).otherwise(1.0)).alias("links"))


def without_gaps(agp: DataFrame, gap: int) -> DataFrame:
    """(object, component, start, end): where components would lie if there were no gaps before them."""
    off = F.floor((F.col("part") - 1) / 2 * gap)
    return agp.where("type = 'W'").select("object", "component", (F.col("start") - off).alias("start"), (F.col("end") - off).alias("end"))


def seconds(text):
    """HH:MM:SS as seconds."""
    part = F.split(text, ":")
    return part[0].cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("long")
