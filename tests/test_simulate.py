from pyspark.sql import functions as F

from strandweave.operators import names
from strandweave.sources import simulate

SEQ = "ACGTTGCAAC" * 50


def test_contigs_hold_the_truth(spark):
    chrom = spark.createDataFrame([("chr1", SEQ), ("chr2", SEQ[::-1])], "name string, seq string")
    got = names.simulated(simulate.contigs(chrom, 60, 0.3)).collect()
    whole = {r.name: r.seq for r in chrom.collect()}
    turn = str.maketrans("ACGT", "TGCA")
    for r in got:
        piece = whole[r.chrom][r.start - 1 : r.end]
        assert r.seq == (piece.translate(turn)[::-1] if r.orient == "-" else piece) and r.len == len(piece)
    assert sum(r.len for r in got) == 2 * len(SEQ)
    assert sorted(r.name for r in got) == sorted(r.name for r in simulate.contigs(chrom.repartition(3), 60, 0.3).collect())


def test_haplotypes(spark):
    chrom = spark.createDataFrame([("chr1", SEQ)], "name string, seq string")
    got = simulate.haplotypes(chrom, 3, 0.1).collect()
    assert len({r.seq for r in got}) == 3
    assert all(len(r.seq) == len(SEQ) + r.n_ins - r.n_del for r in got)
    assert simulate.haplotypes(chrom, 1, 0.0).first().seq == SEQ


def test_chimeras_keep_all_bases(spark):
    parts = spark.createDataFrame([(f"c{k}", "A" * (k + 1)) for k in range(300)], "name string, seq string")
    got = simulate.chimeras(parts, 0.5)
    assert got.agg(F.sum(F.length("seq"))).first()[0] == sum(range(1, 301))
    assert 0 < got.where(F.col("name").startswith("chimeric|")).count() < 150


def test_errors_and_samples(spark):
    v = spark.createDataFrame([("chr1", k, "A", ["A", "C", "-"]) for k in range(400)], "chrom string, pos long, ref string, alleles array<string>")
    got = simulate.switch_errors(v, 0.25).collect()
    assert 50 < sum(r.switched for r in got) < 150
    assert all(r.alleles == (["C", "A", "-"] if r.switched else ["A", "C", "-"]) for r in got)
    g = spark.createDataFrame([(f"c{k}", k % 5) for k in range(500)], "ctg string, grp long")
    rows = simulate.wrong_groups(g, 5, 0.2, 0.1).collect()
    assert 60 < sum(r.grp is not None and r.grp != r.truth for r in rows) < 140 and 25 < sum(r.grp is None for r in rows) < 80
    assert 100 < simulate.sampled(g, 0.3, "ctg").count() < 200
    s = spark.createDataFrame([("x", "ACNNGTNA")], "name string, seq string")
    assert [r.seq for r in simulate.split_at_gaps(s, 2).collect()] == ["AC", "GTNA"]


def test_names(spark):
    df = spark.createDataFrame([("inflation 1.2 has 7 groups",), ("nothing",)], "value string")
    assert [tuple(r) for r in names.logged(df, {"groups": r"has (\d+) groups", "x": "(zzz)"}).collect()] == [("groups", "7")]
    r = spark.range(1).select(names.rotated(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(2)).alias("x")).first()
    assert r.x == [3, 1, 2]
    a, b = F.lit("chr1_2_1_1_9_+_9"), F.lit("chr1_2_7_10_19_-_10")
    assert spark.range(1).select(names.same_homolog(a, b).alias("x")).first().x
