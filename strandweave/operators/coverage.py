"""Coverage by spanning pairs, break points from its valleys, and coordinates after breaking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Bins of a run that are written out at once.
STRETCH = 65_536


def runs(pairs: DataFrame, contigs: DataFrame, resolution: int) -> DataFrame:
    """(ctg, lo, hi, cov): all bins of all contigs, as runs of bins of equal coverage; at most one row for each end of a pair.

    Pairs inside a contig cover every bin from one end to the other. A pair is two events (+1 where it begins, -1 behind
    its end), summed along the contig; events outside of its bins don't count.
    """
    p = pairs.where(F.col("ctg_i") == F.col("ctg_j"))
    bin_ = lambda c: F.floor(F.col(c) / resolution)
    events = F.array(F.struct(bin_("pos_i").alias("bin"), F.lit(1).alias("e")), F.struct((bin_("pos_j") + 1).alias("bin"), F.lit(-1).alias("e")))
    first = contigs.select("ctg", F.struct(F.lit(0).cast("long").alias("bin"), F.lit(0).alias("e")).alias("x"), F.floor(F.col("len") / resolution).alias("last"))
    change = p.select(F.col("ctg_i").alias("ctg"), F.explode(events).alias("x")).join(first.select("ctg", "last"), "ctg").where("x.bin between 0 and last")
    steps = change.unionByName(first.where("last >= 0")).groupBy("ctg", F.col("x.bin").alias("lo"), "last").agg(F.sum("x.e").alias("e"))
    w = Window.partitionBy("ctg").orderBy("lo")
    return steps.select("ctg", "lo", (F.coalesce(F.lead("lo").over(w), F.col("last") + 1) - 1).alias("hi"), F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cov"))


def by_bin(cov: DataFrame) -> DataFrame:
    """(ctg, bin, cov) of runs, a long one stretch by stretch; the runs are so few bytes that their shuffle would leave few tasks."""
    parts = cov.select("ctg", "cov", "hi", F.explode(F.sequence("lo", "hi", F.lit(STRETCH).cast("long"))).alias("at"))
    parts = parts.repartition(int(cov.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return parts.select("ctg", F.explode(F.sequence("at", F.least(F.col("at") + (STRETCH - 1), "hi"))).alias("bin"), "cov")


def coverage(pairs: DataFrame, contigs: DataFrame, resolution: int) -> DataFrame:
    """(ctg, bin, cov) over all bins."""
    return by_bin(runs(pairs, contigs, resolution))


def high_regions(cov: DataFrame, contigs: DataFrame, median_ratio: float, length_ratio: float, least: int, resolution: int) -> DataFrame:
    """(ctg, first_bin, last_bin, seq) from runs: stretches of bins with at least ``median_ratio`` of the median, long enough; two or more a contig."""
    m = cov.groupBy("ctg").agg(F.expr("percentile(cov, 0.5, hi - lo + 1)").alias("m"))
    high = cov.join(m, "ctg").where(F.col("cov") >= F.col("m") * median_ratio)
    order = Window.partitionBy("ctg").orderBy("lo")
    new = F.coalesce((F.lag("hi").over(order) + 1 != F.col("lo")).cast("int"), F.lit(1))
    island = F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    regions = high.withColumn("new", new).withColumn("island", island).groupBy("ctg", "island").agg(F.min("lo").alias("first_bin"), F.max("hi").alias("last_bin"))
    each = Window.partitionBy("ctg")
    regions = regions.withColumn("before", F.count("*").over(each)).where(F.col("before") > 1).join(contigs.select("ctg", "len"), "ctg")
    size = (F.col("last_bin") - F.col("first_bin") + 1) * resolution
    regions = regions.where(size >= F.greatest(F.lit(float(least)), F.col("len") * length_ratio)).withColumn("after", F.count("*").over(each)).where(F.col("after") > 1)
    return regions.select("ctg", "first_bin", "last_bin", F.row_number().over(each.orderBy("first_bin")).cast("long").alias("seq"))


def break_points(cov: DataFrame, regions: DataFrame) -> DataFrame:
    """(ctg, bin, cov): the leftmost empty bin of every valley that has one; where no valley has, the contig's deepest bin.

    Regions and valleys are made of whole runs, so each run looks back to the last region that begins at or before it.
    """
    nxt = F.lead("first_bin").over(Window.partitionBy("ctg").orderBy("seq"))
    begun = regions.select("ctg", F.col("first_bin").alias("lo"), F.struct("seq", "last_bin", nxt.alias("next")).alias("r"))
    last = F.last("r", ignorenulls=True).over(Window.partitionBy("ctg").orderBy("lo").rowsBetween(Window.unboundedPreceding, 0))
    inside = cov.join(begun, ["ctg", "lo"], "left").withColumn("r", last).where("r.next is not null and lo > r.last_bin and lo < r.next")
    lowest = inside.groupBy("ctg", "r.seq").agg(F.min(F.struct("cov", F.col("lo").alias("bin"))).alias("x")).select("ctg", "x.bin", "x.cov")
    by = Window.partitionBy("ctg")
    out = lowest.withColumn("least", F.min("cov").over(by)).withColumn("first", F.row_number().over(by.orderBy("cov", "bin")))
    return out.where(((F.col("least") == 0) & (F.col("cov") == 0)) | ((F.col("least") > 0) & (F.col("first") == 1))).select("ctg", "bin", "cov")


def fragments(breaks: DataFrame, contigs: DataFrame, resolution: int) -> DataFrame:
    """(ctg, start, end, frag), 0-based half-open: contigs cut in the middle of their break bins; unbroken ones keep their name."""
    cuts = breaks.select("ctg", (F.col("bin") * resolution + resolution // 2).alias("start")).join(contigs.select("ctg", "len"), "ctg").where(F.col("start") < F.col("len"))
    starts = cuts.select("ctg", "start", "len").unionByName(contigs.select("ctg", F.lit(0).cast("long").alias("start"), "len"))
    w = Window.partitionBy("ctg").orderBy("start")
    out = starts.withColumn("end", F.coalesce(F.lead("start").over(w), F.col("len"))).withColumn("n", F.count("*").over(Window.partitionBy("ctg")))
    name = F.when(F.col("n") > 1, F.concat(F.col("ctg"), F.lit(":"), (F.col("start") + 1).cast("string"), F.lit("-"), F.col("end").cast("string"))).otherwise(F.col("ctg"))
    return out.select("ctg", "start", "end", name.alias("frag"))


def on_fragments(points: DataFrame, frags: DataFrame) -> DataFrame:
    """(.., frag, frag_pos): the fragment with the largest start at or before each (ctg, pos)."""
    f = frags.select(F.col("ctg").alias("f_ctg"), "start", "end", "frag")
    hit = (points.ctg == F.col("f_ctg")) & (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    return points.join(f, hit).select(*points.columns, "frag", (F.col("pos") - F.col("start")).alias("frag_pos"))


def split_pairs(pairs: DataFrame, breaks: DataFrame, frags: DataFrame, resolution: int) -> DataFrame:
    """Pairs inside a contig after breaking: those that span a break go, the others move to their fragment."""
    p = pairs.where(F.col("ctg_i") == F.col("ctg_j")).select(F.col("ctg_i").alias("ctg"), "pos_i", "pos_j")
    b = breaks.select(F.col("ctg").alias("b_ctg"), (F.col("bin") * resolution + resolution // 2).alias("cut"))
    rest = p.join(b, (p.ctg == F.col("b_ctg")) & (F.col("pos_i") < F.col("cut")) & (F.col("pos_j") >= F.col("cut")), "left_anti")
    moved = on_fragments(rest.withColumnRenamed("pos_i", "pos"), frags)
    return moved.select("frag", F.col("frag_pos").alias("pos_i"), (F.col("pos_j") - (F.col("pos") - F.col("frag_pos"))).alias("pos_j"))
