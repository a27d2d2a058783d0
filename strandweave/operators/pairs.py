"""Row-wise operators on read pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def known(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Pairs both of whose contigs are in ``contigs``."""
    ids = contigs.select("ctg")
    return pairs.join(ids, pairs.ref == ids.ctg, "left_semi").join(ids, pairs.mref == ids.ctg, "left_semi")


def canonical(pairs: DataFrame) -> DataFrame:
    """(read_id, ctg_i, pos_i, ctg_j, pos_j) with (ctg_i, pos_i) <= (ctg_j, pos_j)."""
    here, there = F.struct(F.col("ref").alias("c"), F.col("pos").alias("p")), F.struct(F.col("mref").alias("c"), F.col("mpos").alias("p"))
    lo, hi = F.least(here, there), F.greatest(here, there)
    return pairs.select("read_id", lo["c"].alias("ctg_i"), lo["p"].alias("pos_i"), hi["c"].alias("ctg_j"), hi["p"].alias("pos_j"))


def between_contigs(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("ctg_i") != F.col("ctg_j"))


def with_lengths(pairs: DataFrame, contigs: DataFrame) -> DataFrame:
    """Adds len_i and len_j."""
    one = lambda side: contigs.select(F.col("ctg").alias(f"ctg_{side}"), F.col("len").alias(f"len_{side}"))
    return pairs.join(one("i"), "ctg_i").join(one("j"), "ctg_j")


def in_flank(pos: Column, length: Column, flank: int) -> Column:
    """Within ``flank`` of either end; flank 0 takes all."""
    return F.lit(True) if flank == 0 else (pos <= flank) | (pos > length - flank)


def half(pos: Column, length: Column) -> Column:
    return F.when(pos * 2 > length, F.lit("T")).otherwise(F.lit("H"))


def distances(pairs: DataFrame) -> DataFrame:
    """Adds the distance of both ends for each of the four relative orientations of two adjacent contigs."""
    i, j, li, lj = (F.col(c) for c in ("pos_i", "pos_j", "len_i", "len_j"))
    return pairs.withColumns({"d_pp": li - i + j, "d_pm": li - i + lj - j, "d_mp": i + j, "d_mm": i + lj - j})


def to_bins(pairs: DataFrame, bin_size: int) -> DataFrame:
    """Fragments in place of contigs: 1-based bins of fixed width, in canonical order again, without pairs inside one bin."""
    number = lambda p: F.greatest(F.ceil(F.col(p) / bin_size), F.lit(1)).cast("long")
    p = pairs.select("ctg_i", number("pos_i").alias("bin_i"), "ctg_j", number("pos_j").alias("bin_j")).where("ctg_i <> ctg_j or bin_i <> bin_j")
    kept = F.expr("ctg_i < ctg_j or (ctg_i = ctg_j and bin_i <= bin_j)")
    pick = lambda x, y: F.when(kept, F.col(x)).otherwise(F.col(y))
    return p.select(pick("ctg_i", "ctg_j").alias("ctg_i"), pick("bin_i", "bin_j").alias("bin_i"), pick("ctg_j", "ctg_i").alias("ctg_j"), pick("bin_j", "bin_i").alias("bin_j"))


def bed_rows(pairs: DataFrame) -> DataFrame:
    """Two rows of six columns for every raw pair."""
    ends = F.array(F.struct(F.col("ref").alias("chrom"), F.col("pos").alias("start"), F.lit("/1").alias("mate")), F.struct(F.col("mref").alias("chrom"), F.col("mpos").alias("start"), F.lit("/2").alias("mate")))
    return pairs.select("read_id", F.explode(ends).alias("e")).select("e.chrom", "e.start", (F.col("e.start") + 1).alias("end"), F.concat(F.col("read_id").cast("string"), F.col("e.mate")).alias("name"), F.lit(255).alias("score"), F.lit(".").alias("strand"))
