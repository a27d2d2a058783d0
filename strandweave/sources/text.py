"""Text formats as typed frames: assemblies, read pairs, layouts, alignments, graphs, groups and tours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value) of all lines that are not blank; compressed files are read as they are."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.trim("value") != "")


def fields(df: DataFrame, by: str = r"\s+") -> DataFrame:
    return df.where(~F.col("value").startswith("#")).withColumn("f", F.split(F.trim("value"), by))


def field(k: int, kind: str = "string") -> Column:
    return F.try_element_at("f", F.lit(k)).try_cast(kind)


def fasta(spark: SparkSession, path: str, keep_case: bool = False) -> DataFrame:
    """(name, seq) of each record; one task reads a record, records of a file are split among tasks.

    The record separator is a line feed with '>', so that sign within a header does not cut; names end at white space.
    """
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(record, r"^([^\r\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(record, r"^[^\r\n]*", ""), r"\s+", "")
    return raw.select(F.split(F.trim(head), r"\s+")[0].alias("name"), (body if keep_case else F.upper(body)).alias("seq"))


def fasta_lengths(spark: SparkSession, path: str) -> DataFrame:
    return fasta(spark, path).select("name", F.length("seq").cast("long").alias("len"))


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, ref, pos, mref, mpos): columns 1 to 5 of .pairs files; positions become 0-based."""
    f = fields(lines(spark, path))
    return f.select(field(1).alias("read_id"), field(2).alias("ref"), (field(3, "long") - 1).alias("pos"), field(4).alias("mref"), (field(5, "long") - 1).alias("mpos"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """(qname, flag, ref, pos, mapq, cigar, mref, mpos, nm) of SAM text; 0-based; '=' is the read's own reference."""
    f = lines(spark, path).where(~F.col("value").startswith("@")).withColumn("f", F.split("value", "\t"))
    nm = F.regexp_extract("value", r".*\tNM:i:(\d+)", 1)
    mate = F.when(field(7) == "=", field(3)).otherwise(field(7))
    return f.select(field(1).alias("qname"), field(2, "int").alias("flag"), field(3).alias("ref"), (field(4, "long") - 1).alias("pos"), field(5, "int").alias("mapq"), field(6).alias("cigar"), mate.alias("mref"), (field(8, "long") - 1).alias("mpos"), F.when(nm != "", nm.cast("int")).alias("nm"))


AGP = "object string, start long, end long, part int, type string, c6 string, c7 string, c8 string, c9 string"


def agp(spark: SparkSession, path: str) -> DataFrame:
    """Nine typed columns and gap_len; what a row's type does not have is null."""
    raw = spark.read.csv(path, sep="\t", schema=AGP, comment="#")
    seq = F.col("type") == "W"
    when = lambda c, kind="string": F.when(seq, F.col(c).cast(kind))
    return raw.select("object", "start", "end", "part", "type", when("c6").alias("component"), when("c7", "long").alias("cstart"), when("c8", "long").alias("cend"), when("c9").alias("orient"), F.when(~seq, F.expr("try_cast(c6 as long)")).alias("gap_len"))


def paf(spark: SparkSession, path: str) -> DataFrame:
    """Twelve columns, and tags as a map; of a tag that comes again, the last."""
    f = lines(spark, path).withColumn("f", F.split("value", "\t"))
    names = [("qname", "string"), ("qlen", "long"), ("qstart", "long"), ("qend", "long"), ("strand", "string"), ("rname", "string"), ("rlen", "long"), ("rstart", "long"), ("rend", "long"), ("matches", "long"), ("block", "long"), ("mapq", "int")]
    tags = F.slice("f", 13, F.greatest(F.size("f") - 12, F.lit(0)))
    pair = F.transform(tags, lambda t: F.struct(F.substring_index(t, ":", 2).alias("k"), F.regexp_extract(t, r"^[^:]*:[^:]*:(.*)$", 1).alias("v")))
    last = F.aggregate(pair, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["k"]), F.map_from_arrays(F.array(x["k"]), F.array(x["v"]))))
    return f.select(*(field(k + 1, kind).alias(n) for k, (n, kind) in enumerate(names)), last.alias("tags"))


def gfa_segments(spark: SparkSession, path: str, depth_tag: str = "rd") -> DataFrame:
    """(file, name, len, depth) of S lines; decimals of a depth are cut off."""
    f = lines(spark, path).where(F.col("value").startswith("S\t")).withColumn("f", F.split("value", "\t"))
    tag = lambda t: F.regexp_extract("value", rf".*\t{t}:[if]:([\d.]+)", 1)
    number = lambda x: F.when(x != "", F.floor(x.cast("double"))).cast("long")
    return f.select("file", field(2).alias("name"), F.coalesce(number(tag("LN")), F.length(field(3)).cast("long")).alias("len"), number(tag(depth_tag)).alias("depth"))


def renamed_gfa(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """(file, value): lines with segment names replaced by (old, new); names without a new one stay."""
    f = lines(spark, path).withColumn("f", F.split("value", "\t")).withColumn("n", F.monotonically_increasing_id())
    place = F.when(field(1).isin("S"), F.array(F.lit(2))).when(field(1) == "L", F.array(F.lit(2), F.lit(4))).when(field(1) == "A", F.array(F.lit(2))).otherwise(F.array().cast("array<int>"))
    part = f.select("file", "n", F.posexplode("f").alias("p", "x"), place.alias("at"))
    new = part.join(ids, part.x == ids.old, "left").withColumn("x", F.when(F.array_contains("at", F.col("p") + 1) & F.col("new").isNotNull(), F.col("new")).otherwise(F.col("x")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]), "\t")
    return new.groupBy("file", "n").agg(joined.alias("value")).select("file", "value")


def bed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="chrom string, start long, end long, name string, score string, strand string", comment="#")


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(grp, ctg, place) of clusters files: group, number, contigs between blanks."""
    f = lines(spark, path).where(~F.col("value").startswith("#")).withColumn("f", F.split("value", "\t"))
    return f.select(field(1).alias("grp"), F.posexplode(F.split(F.trim(field(3)), r"\s+")).alias("p", "ctg")).select("grp", "ctg", (F.col("p") + 1).cast("long").alias("place"))


def group_file(spark: SparkSession, path: str) -> DataFrame:
    """(grp, ctg, re_sites, len); the group is the file's name."""
    f = fields(lines(spark, path), "\t")
    name = F.regexp_replace(F.substring_index("file", "/", -1), r"\.txt$", "")
    return f.select(name.alias("grp"), field(1).alias("ctg"), field(2, "long").alias("re_sites"), field(3, "long").alias("len"))


def assembly(spark: SparkSession, path: str) -> DataFrame:
    """(file, grp, idx, ctg, orient, len) of .assembly files: numbered contigs, then a line of signed numbers for each group."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.split("value", "\r?\n")).alias("value")).where(F.trim("value") != "")
    head = raw.where(F.col("value").startswith(">")).withColumn("f", F.split("value", r"\s+")).select("file", F.substring(field(1), 2, 1 << 20).alias("ctg"), field(2, "long").alias("number"), field(3, "long").alias("len"))
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.filter(F.split("value", "\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith(">")).alias("groups"))
    part = whole.select("file", F.posexplode("groups").alias("g", "row")).select("file", "g", F.posexplode(F.split(F.trim("row"), r"\s+")).alias("p", "n"))
    signed = part.select("file", F.concat(F.lit("group"), (F.col("g") + 1).cast("string")).alias("grp"), (F.col("p") + 1).cast("long").alias("idx"), F.abs(F.col("n").cast("long")).alias("number"), F.when(F.col("n").startswith("-"), "-").otherwise("+").alias("orient"))
    return signed.join(head, ["file", "number"]).select("file", "grp", "idx", "ctg", "orient", "len")


def tours(spark: SparkSession, path: str) -> DataFrame:
    """(grp, idx, ctg, orient) of .tour files: the last line counts; the group is the file's name up to its last '_'."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.element_at(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != ""), -1).alias("row"))
    base = F.regexp_replace(F.substring_index("file", "/", -1), r"\.tour$", "")
    t = raw.select(F.regexp_replace(base, r"_[^_]*$", "").alias("grp"), F.posexplode(F.split(F.trim("row"), r"\s+")).alias("p", "x"))
    return t.select("grp", (F.col("p") + 1).cast("long").alias("idx"), F.expr("left(x, length(x) - 1)").alias("ctg"), F.right("x", F.lit(1)).alias("orient"))


def tour_scores(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, last, n): scores of the optimiser's header lines, >GA..-score."""
    s = lines(spark, path).where(F.col("value").startswith(">GA")).select("file", F.monotonically_increasing_id().alias("k"), F.regexp_extract("value", r"-([\d.]+)\s*$", 1).cast("double").alias("score"))
    return s.groupBy("file").agg(F.min_by("score", "k").alias("first"), F.max_by("score", "k").alias("last"), F.count("*").alias("n"))


def clm(spark: SparkSession, path: str) -> DataFrame:
    """(ctg_i, ori_i, ctg_j, ori_j, links, distances)."""
    f = lines(spark, path).withColumn("f", F.split("value", "\t")).withColumn("c", F.split(field(1), " "))
    name = lambda k: F.expr(f"left(c[{k}], length(c[{k}]) - 1)")
    d = F.transform(F.split(F.trim(field(3)), " "), lambda x: x.cast("long"))
    return f.select(name(0).alias("ctg_i"), F.right(F.col("c")[0], F.lit(1)).alias("ori_i"), name(1).alias("ctg_j"), F.right(F.col("c")[1], F.lit(1)).alias("ori_j"), field(2, "long").alias("links"), d.alias("distances"))


def truth(spark: SparkSession, path: str) -> DataFrame:
    """(source, pos, ctg, orient) of truth files: '>source' lines, each with rows of contig and orientation below."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("pos", "value"), F.col("_metadata.file_path").alias("file"))
    w = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("value").startswith(">"), F.trim(F.substring("value", 2, 1 << 20)))
    t = raw.withColumn("source", F.last(head, ignorenulls=True).over(w)).where(~F.col("value").startswith(">")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    return t.select("source", F.col("pos").cast("long").alias("pos"), field(1).alias("ctg"), field(2).alias("orient"))


def fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual): records of four lines, by the line's number in its file; a file is one task, as its lines count from its start."""
    w = Window.partitionBy("file").orderBy("k")
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("k"), "value")
    n = F.row_number().over(w) - 1
    g = raw.withColumn("n", n).groupBy("file", F.floor(F.col("n") / 4).alias("r"))
    at = lambda k: F.max(F.when(F.col("n") % 4 == k, F.col("value")))
    return g.agg(F.expr("substring(max(case when n % 4 = 0 then value end), 2)").alias("name"), at(1).alias("seq"), at(3).alias("qual")).drop("r", "file")


def alleles(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, ref, alleles) of variant tables with any number of haplotype columns."""
    f = fields(lines(spark, path))
    return f.where(field(3, "long").isNotNull()).select(field(2).alias("chrom"), field(3, "long").alias("pos"), field(4).alias("ref"), F.slice("f", 5, F.greatest(F.size("f") - 4, F.lit(0))).alias("alleles"))


def corrected_names(spark: SparkSession, path: str) -> DataFrame:
    """(frag, ctg, start, end) of lists of broken contigs, ctg:start-end, 1-based and closed."""
    v = F.trim("value")
    part = F.regexp_extract(v, r"^(.*):(\d+)-(\d+)$", 1), F.regexp_extract(v, r"^(.*):(\d+)-(\d+)$", 2), F.regexp_extract(v, r"^(.*):(\d+)-(\d+)$", 3)
    return lines(spark, path).select(v.alias("frag"), part[0].alias("ctg"), part[1].cast("long").alias("start"), part[2].cast("long").alias("end"))


FORMATS = {"bam": ("bam",), "pairs": ("pairs", "pairs.gz"), "sam": ("sam", "sam.gz"), "paf": ("paf", "paf.gz"), "agp": ("agp",), "fasta": ("fa", "fasta", "fa.gz", "fasta.gz")}


def detected(path: str) -> str:
    """The format that a file's name ends in."""
    for kind, ends in FORMATS.items():
        if path.lower().endswith(tuple(f".{e}" for e in ends)):
            return kind
    raise ValueError(f"unknown format: {path}")
