"""Alignment filters and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paf_kept(paf: DataFrame, mapq: int, least_len: int, least_span: int) -> DataFrame:
    """Alignments with quality, lengths of both sequences, span on the reference, and a divergence."""
    return paf.where((F.col("mapq") >= mapq) & (F.least("qlen", "rlen") >= least_len) & (F.col("rend") - F.col("rstart") >= least_span) & F.col("de").isNotNull())


def identities(paf: DataFrame) -> DataFrame:
    """(qname, rname, gap_compressed, blast): match-weighted identities in percent."""
    m = F.col("matches")
    return paf.groupBy("qname", "rname").agg(((1 - F.sum(m * F.col("de")) / F.sum(m)) * 100).alias("gap_compressed"), (F.sum(m) / F.sum("block") * 100).alias("blast"))


def aligned_lengths(paf: DataFrame, cutoff: int) -> DataFrame:
    """(qname, rname, len): bases of a query on each reference, by alignments of at least ``cutoff``."""
    kept = paf.where((F.col("mapq") >= 1) & (F.col("qend") - F.col("qstart") >= cutoff))
    return kept.groupBy("qname", "rname").agg(F.sum(F.col("qend") - F.col("qstart")).alias("len"))


def dominant_reference(lengths: DataFrame) -> DataFrame:
    """(qname, rname): the reference with most aligned bases; ties to the larger name."""
    return lengths.groupBy("qname").agg(F.max_by("rname", F.struct("len", "rname")).alias("rname"))


def mate_filter(sam: DataFrame, mapq: int, nm: int, both: bool, keep_duplicates: bool) -> DataFrame:
    """(qname) of pairs in (qname, flag, mapq, nm): enough quality (both mates, or either), few mismatches on both, no duplicates."""
    g = sam.groupBy("qname").agg(F.count("*").alias("n"), F.min("mapq").alias("low"), F.max("mapq").alias("high"), F.max("nm").alias("nm"), F.max(F.col("flag").bitwiseAND(1024)).alias("dup"))
    ok = (F.col("n") == 2) & ((F.col("low") if both else F.col("high")) >= mapq) & (F.col("nm") < nm)
    return g.where(ok if keep_duplicates else ok & (F.col("dup") == 0)).select("qname")


def end_points(paf: DataFrame) -> DataFrame:
    """(line, n, q, r): the two ends of each alignment, for dot plots; a reverse one runs down."""
    up = F.col("strand") == "+"
    ends = F.array(F.struct(F.lit(0).alias("n"), F.col("qstart").alias("q"), F.when(up, F.col("rstart")).otherwise(F.col("rend")).alias("r")), F.struct(F.lit(1).alias("n"), F.col("qend").alias("q"), F.when(up, F.col("rend")).otherwise(F.col("rstart")).alias("r")))
    return paf.select("line", F.explode(ends).alias("e")).select("line", "e.n", "e.q", "e.r")


def shared_span(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, shared, pct): overlap of closed intervals (s1, e1) and (s2, e2) of one key, and its share of the first."""
    cut = F.greatest(F.least("e1", "e2") - F.greatest("s1", "s2") + 1, F.lit(0))
    return a.join(b, key).select(key, "s1", "e1", cut.alias("shared"), (100.0 * cut / (F.col("e1") - F.col("s1") + 1)).alias("pct"))
