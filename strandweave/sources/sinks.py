"""Frames as text in the formats that other tools read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.operators import sequence


def _tab(*columns) -> Column:
    return F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("")) for c in columns))


def agp_lines(rows: DataFrame) -> DataFrame:
    gap = F.col("type") != "W"
    c6 = F.when(gap, (F.col("end") - F.col("start") + 1).cast("string")).otherwise(F.col("component"))
    c7 = F.when(gap, "scaffold").otherwise(F.col("cstart").cast("string"))
    c8 = F.when(gap, "yes").otherwise(F.col("cend").cast("string"))
    c9 = F.when(gap, "proximity_ligation").otherwise(F.col("orient"))
    return rows.select("object", "part", _tab("object", "start", "end", "part", "type", c6, c7, c8, c9).alias("value")).orderBy("object", "part").select("value")


def fasta_lines(seqs: DataFrame, width: int = 60) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), sequence.wrapped(F.col("seq"), width)).alias("value"))


def scaffold_sequences(rows: DataFrame, seqs: DataFrame) -> DataFrame:
    """(name, seq) of the objects of a layout: their parts in order, reversed where the layout says so, N for gaps."""
    own = rows.join(seqs, rows.component == seqs.name, "left")
    part = F.when(F.col("type") != "W", F.expr("repeat('N', cast(end - start + 1 as int))")).when(F.col("orient") == "-", sequence.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    g = own.groupBy("object").agg(F.array_sort(F.collect_list(F.struct("part", part.alias("s")))).alias("parts"))
    return g.select(F.col("object").alias("name"), F.array_join(F.transform("parts", lambda x: x["s"]), "").alias("seq"))


def clm_lines(distances: DataFrame) -> DataFrame:
    """Every distance twice, and twice the count."""
    twice = F.flatten(F.transform("distances", lambda x: F.array(x, x)))
    pair = F.concat(F.col("ctg_i"), F.col("ori_i"), F.lit(" "), F.col("ctg_j"), F.col("ori_j"))
    return distances.select(_tab(pair, F.col("links") * 2, F.array_join(twice, " ")).alias("value"))


def split_by_group(distances: DataFrame, contigs: DataFrame) -> DataFrame:
    """(grp, value): lines of pairs both of whose contigs are in one group, to be written by group."""
    g = lambda s: contigs.select(F.col("ctg").alias(f"ctg_{s}"), F.col("grp").alias(f"g_{s}"))
    own = distances.join(g("i"), "ctg_i").join(g("j"), "ctg_j").where("g_i = g_j")
    return own.select(F.col("g_i").alias("grp"), F.concat(F.col("ctg_i"), F.col("ori_i"), F.lit(" "), F.col("ctg_j"), F.col("ori_j"), F.lit("\t"), (F.col("links") * 2).cast("string"), F.lit("\t"), F.array_join(F.flatten(F.transform("distances", lambda x: F.array(x, x))), " ")).alias("value"))


def tour_lines(tours: DataFrame) -> DataFrame:
    """(grp, value) with the two lines of each tour file."""
    row = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.concat("ctg", "orient").alias("x")))), lambda s: s["x"]), " ")
    return tours.groupBy("grp").agg(F.concat(F.lit(">INIT\n"), row).alias("value"))


def ranked_groups(contigs: DataFrame) -> DataFrame:
    """(grp, name): groups named by rank of length, group{n}_{length}bp; there are few groups."""
    from pyspark.sql.window import Window

    t = contigs.where("grp is not null").groupBy("grp").agg(F.sum("len").alias("len"))
    n = F.row_number().over(Window.orderBy(F.col("len").desc(), "grp"))
    return t.select("grp", F.concat(F.lit("group"), n.cast("string"), F.lit("_"), F.col("len").cast("string"), F.lit("bp")).alias("name"))


def cluster_lines(contigs: DataFrame) -> DataFrame:
    """Lines of a clusters file: name, number of contigs, contigs."""
    names = ranked_groups(contigs)
    members = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("len")).alias("l"), "ctg"))), lambda s: s["ctg"]), " ")
    g = contigs.where("grp is not null").groupBy("grp").agg(F.count("*").alias("n"), members.alias("m")).join(names, "grp")
    return g.select(_tab("name", "n", "m").alias("value"))


def group_lines(contigs: DataFrame) -> DataFrame:
    """(grp, value): rows of group files."""
    return contigs.where("grp is not null").select("grp", _tab("ctg", "re_sites", "len").alias("value"))


def truth_lines(truth: DataFrame) -> DataFrame:
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "ctg", "orient").alias("x")))), lambda s: s["x"]), "\n")
    return truth.groupBy("source").agg(F.concat(F.lit(">"), F.col("source"), F.lit("\n"), rows).alias("value")).select("value")


def write_lines(df: DataFrame, path: str, by: str | None = None) -> None:
    """Text files below a new folder, one sub-folder for each value of ``by``; an existing folder is an error."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(by) if by else w).text(path)


def write_matrix(matrix: DataFrame, path: str, **parameters) -> None:
    """A contact matrix with what it was made from, so that a reader can refuse another one."""
    spark = matrix.sparkSession
    matrix.write.mode("errorifexists").parquet(f"{path}/cells")
    spark.createDataFrame([(k, str(v)) for k, v in sorted(parameters.items())], "key string, value string").coalesce(1).write.parquet(f"{path}/parameters")


def read_matrix(spark, path: str, **parameters) -> DataFrame:
    found = {r.key: r.value for r in spark.read.parquet(f"{path}/parameters").collect()}
    wanted = {k: str(v) for k, v in parameters.items()}
    if found != wanted:
        raise ValueError(f"the matrix was made with {found}, not {wanted}")
    return spark.read.parquet(f"{path}/cells")
