"""Operators on sequences."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expanded(site: str) -> list[str]:
    """A restriction site with every N written out."""
    return ["".join(x) for x in product(*("ATCG" if c == "N" else c for c in site))]


def motif_count(seq: Column, sites: str) -> Column:
    """Non-overlapping occurrences of each of the comma-separated sites, summed."""
    words = [w for s in sites.split(",") for w in expanded(s)]
    return reduce(lambda a, b: a + b, (F.regexp_count(seq, F.lit(w)) for w in words)).cast("long")


def flank_motif_count(seq: Column, sites: str, flank: int) -> Column:
    head, tail = F.substring(seq, 1, flank), F.right(seq, F.lit(flank))
    return F.when(F.length(seq) <= 2 * flank, motif_count(seq, sites)).otherwise(motif_count(head, sites) + motif_count(tail, sites))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ATCGatcg", "TAGCtagc"))


#: Letters of a piece within which windows are cut out; a substring costs a walk from the start of its string.
PIECE = 256


def _windows(seqs: DataFrame, key: str, k: int) -> DataFrame:
    """(key, w): all windows of k letters without N."""
    parts = chunks(seqs.select(F.col(key).alias("name"), "seq"), PIECE, k - 1).where(F.length("seq") >= k)
    at = F.sequence(F.lit(1), F.length("seq") - k + 1)
    return parts.select(F.col("name").alias(key), F.explode(F.transform(at, lambda p: F.substring("seq", p, F.lit(k)))).alias("w")).where(~F.col("w").contains("N"))


def _smaller(w: Column) -> Column:
    return F.least(w, reverse_complement(w))


def canonical_kmers(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer, n): the smaller of each k-mer and its reverse complement, without those that hold N.

    Windows are counted as they are, at most 4**k keys of each task, and only the distinct ones are reversed.
    """
    raw = _windows(seqs, "name", k).groupBy("w").agg(F.count("*").alias("n"))
    return raw.groupBy(_smaller(F.col("w")).alias("kmer")).agg(F.sum("n").alias("n"))


def kmer_composition(seqs: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """(source, kmers, n): how many k-mers of ``seqs`` occur in each source of (source, seq)."""
    theirs = _windows(reference, "source", k).select("source", _smaller(F.col("w")).alias("kmer")).distinct()
    return canonical_kmers(seqs, k).join(theirs, "kmer").groupBy("source").agg(F.count("*").alias("kmers"), F.sum("n").alias("n"))


def n_runs(seqs: DataFrame) -> DataFrame:
    """(length, n): runs of N by length."""
    return seqs.select(F.explode(F.regexp_extract_all("seq", F.lit("(N+)"), 1)).alias("r")).groupBy(F.length("r").cast("long").alias("length")).agg(F.count("*").alias("n"))


def telomeres(seqs: DataFrame, motif: str) -> DataFrame:
    """(name, n, per_mb, first, last): doublets of the motif: count, density, and relative places of the first and last; null without."""
    two = motif * 2
    n = F.regexp_count("seq", F.lit(two)).cast("long")
    size = F.length("seq")
    first = F.locate(two, F.col("seq"))
    last = size - F.locate(two[::-1], F.reverse("seq")) - len(two) + 2
    some = n > 0
    return seqs.where(size > 0).select("name", n.alias("n"), (n * 1e6 / size).alias("per_mb"), F.when(some, first / size).alias("first"), F.when(some, last / size).alias("last"))


def wrapped(seq: Column, width: int) -> Column:
    return F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def chunks(seqs: DataFrame, size: int, overlap: int) -> DataFrame:
    """(name, chunk, seq): pieces of at most ``size`` letters; each reaches ``overlap`` letters into the next, for motifs across borders."""
    at = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("seq") / size) - 1, F.lit(0)))
    return seqs.select("name", F.explode(at).alias("chunk"), "seq").select("name", "chunk", F.substring("seq", F.col("chunk").cast("int") * size + 1, F.lit(size + overlap)).alias("seq"))
