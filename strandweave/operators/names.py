"""What contig names and log lines say: source, range and strand of simulated contigs, broken pieces, read ranges of CIGARs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: <chrom>_<hap>_<n>_<start>_<end>_<orient>_<len>
SIMULATED = r"^(.+)_([^_]+)_(\d+)_(\d+)_(\d+)_([+-])_(\d+)$"
PIECE = r"^(.*?)(?::(\d+)-(\d+)|(?:_break\d+)+)$"


def simulated(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds chrom, hap, number, start, end, orient and len of simulated names; null for others."""
    part = lambda k: F.regexp_extract(name, SIMULATED, k)
    hit = F.col(name).rlike(SIMULATED)
    kinds = (("chrom", 1, "string"), ("hap", 2, "string"), ("number", 3, "long"), ("start", 4, "long"), ("end", 5, "long"), ("orient", 6, "string"), ("len", 7, "long"))
    return df.withColumns({c: F.when(hit, part(k)).try_cast(t) for c, k, t in kinds})


def parent(name: Column) -> Column:
    """The contig that a broken piece comes from; other names are their own."""
    own = F.regexp_extract(name, PIECE, 1)
    return F.when(own != "", own).otherwise(name)


def source_of(name: Column, chromosome: str) -> Column:
    """The chromosome in a name, by a regex with one group, else 'unanchored'."""
    found = F.regexp_extract(name, chromosome, 1)
    return F.when(found != "", found).otherwise(F.lit("unanchored"))


def read_range(cigar: Column, reverse: Column, length: Column) -> Column:
    """(start, end) on the read, 0-based half-open, of an alignment whose ends may be clipped; ``length`` is the aligned part's."""
    clip = lambda rx: F.coalesce(F.regexp_extract(cigar, rx, 1).try_cast("long"), F.lit(0))
    head, tail = clip(r"^(\d+)[HS]"), clip(r"(\d+)[HS]$")
    before = F.when(reverse, tail).otherwise(head)
    return F.struct(before.alias("start"), (before + length).alias("end"))


def read_length(cigar: Column) -> Column:
    """Bases of the read that a CIGAR uses, without clips."""
    runs = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MI=X]"), 1)
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def rotated(items: Column, k: Column) -> Column:
    """A list that begins at its k-th item (from 0) and wraps round."""
    n = F.size(items)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: items[(i + k) % n])


def motif_histogram(seqs: DataFrame, motif: str, bins: int) -> DataFrame:
    """(name, bin, n): non-overlapping occurrences of a motif by relative place; splitting at it gives all places in one pass."""
    parts = F.split("seq", motif)
    step = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x: F.length(x))
    ends = F.aggregate(step, F.array().cast("array<int>"), lambda a, x: F.array_append(a, F.when(F.size(a) == 0, x).otherwise(F.element_at(a, -1) + len(motif) + x)), lambda a: a)
    at = F.when(F.size(parts) > 1, ends).otherwise(F.array().cast("array<int>"))
    return seqs.select("name", F.length("seq").alias("l"), F.explode(at).alias("p")).groupBy("name", F.floor(F.col("p") * bins / F.col("l")).alias("bin")).agg(F.count("*").alias("n"))


def logged(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(metric, value) of log lines, one row for each metric whose regex (with one group) matches."""
    found = F.array(*(F.struct(F.lit(k).alias("metric"), F.regexp_extract("value", rx, 1).alias("value")) for k, rx in patterns.items()))
    return lines.select(F.explode(found).alias("m")).where(F.col("m.value") != "").select("m.metric", F.col("m.value").alias("value"))


def same_homolog(a: Column, b: Column) -> Column:
    """Whether two simulated names share chromosome and haplotype."""
    part = lambda x, k: F.regexp_extract(x, SIMULATED, k)
    return (part(a, 1) != "") & (part(a, 1) == part(b, 1)) & (part(a, 2) == part(b, 2))
