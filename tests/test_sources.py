import gzip
import struct
import zlib

import pytest

from strandweave.operators import layout, links
from strandweave.sources import sinks, text
from strandweave.sources.bam import BamSource


def put(tmp_path, name, body):
    p = tmp_path / name
    p.write_text(body)
    return str(p)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_fasta(spark, tmp_path):
    p = put(tmp_path, "a.fa", ">one first > record\nACGT\nacg\n\n>two\nNNNN\n>empty\n")
    assert rows(text.fasta(spark, p), "name") == [("empty", ""), ("one", "ACGTACG"), ("two", "NNNN")]
    assert rows(text.fasta_lengths(spark, p), "name") == [("empty", 0), ("one", 7), ("two", 4)]
    back = sinks.fasta_lines(text.fasta(spark, p), 3)
    assert (">one\nACG\nTAC\nG",) in rows(back)


def test_pairs_plain_and_compressed(spark, tmp_path):
    body = "## pairs\n#columns: x\nr1 a 5 b 7 + -\n\nr2\tb\t1\tb\t9\n"
    p = put(tmp_path, "x.pairs", body)
    q = tmp_path / "y.pairs.gz"
    q.write_bytes(gzip.compress(body.encode()))
    want = [("r1", "a", 4, "b", 6), ("r2", "b", 0, "b", 8)]
    assert rows(text.pairs(spark, p), "read_id") == rows(text.pairs(spark, str(q)), "read_id") == want


def test_agp_round_trip(spark, tmp_path):
    frame = spark.createDataFrame([("s", 1, "c1", 10, "+"), ("s", 2, "c2", 20, "-")], "object string, idx long, ctg string, len long, orient string")
    own = layout.agp(frame, 5)
    out = str(tmp_path / "agp")
    sinks.write_lines(sinks.agp_lines(own), out)
    got = text.agp(spark, out)
    assert rows(got.drop("gap_len"), "part") == [tuple(r) for r in own.select(*got.drop("gap_len").columns).orderBy("part").collect()]
    assert [r.gap_len for r in got.orderBy("part").collect()] == [None, 5, None]
    seqs = spark.createDataFrame([("c1", "A" * 10), ("c2", "ACGTT" * 4)], "name string, seq string")
    assert rows(sinks.scaffold_sequences(own, seqs)) == [("s", "A" * 10 + "N" * 5 + "AACGT" * 4)]


def test_paf_tags_keep_the_last(spark, tmp_path):
    p = put(tmp_path, "x.paf", "q\t9\t1\t5\t+\tr\t99\t10\t20\t4\t5\t60\tde:f:0.1\tde:f:0.2\tcg:Z:4M:x\n" "q\t9\t1\t5\t-\tr\t99\t10\t20\t4\t5\t60\n")
    got = [r.tags for r in text.paf(spark, p).orderBy("strand").collect()]
    assert got == [{"de:f": "0.2", "cg:Z": "4M:x"}, {}]


def test_gfa(spark, tmp_path):
    p = put(tmp_path, "x.gfa", "H\tVN\nS\tu1\tACGT\tLN:i:4\trd:i:7\nS\tu2\t*\tLN:i:9\trd:f:3.6\nL\tu1\t+\tu2\t-\t0M\n")
    assert rows(text.gfa_segments(spark, p).drop("file"), "name") == [("u1", 4, 7), ("u2", 9, 3)]
    ids = spark.createDataFrame([("u1", "n1")], "old string, new string")
    assert ("L\tn1\t+\tu2\t-\t0M",) in rows(text.renamed_gfa(spark, p, ids).select("value"))


def test_groups_tours_and_truth(spark, tmp_path):
    c = put(tmp_path, "c.txt", "#Group\tnContigs\tContigs\ng1\t2\ta b\ng2\t1\tc\n")
    assert rows(text.clusters(spark, c), "grp", "place") == [("g1", "a", 1), ("g1", "b", 2), ("g2", "c", 1)]
    t = put(tmp_path, "group1_12bp.tour", ">INIT\nb- a+\n>GA1-12.5\na+ b-\n\n")
    assert rows(text.tours(spark, t), "idx") == [("group1", 1, "a", "+"), ("group1", 2, "b", "-")]
    assert [(r.first, r.last, r.n) for r in text.tour_scores(spark, t).collect()] == [(12.5, 12.5, 1)]
    assert rows(sinks.tour_lines(text.tours(spark, t))) == [("group1", ">INIT\na+ b-")]
    u = put(tmp_path, "truth.txt", ">chr1\na +\nb -\n>unanchored\nc +\n")
    assert [(r.source, r.ctg, r.orient) for r in text.truth(spark, u).orderBy("pos").collect()] == [("chr1", "a", "+"), ("chr1", "b", "-"), ("unanchored", "c", "+")]
    a = put(tmp_path, "x.assembly", ">a 1 10\n>b 2 20\n2 -1\n")
    assert rows(text.assembly(spark, a).drop("file"), "idx") == [("group1", 1, "b", "+", 20), ("group1", 2, "a", "-", 10)]
    g = put(tmp_path, "group7.txt", "#Contig\tRECounts\tLength\na\t3\t10\n")
    assert rows(text.group_file(spark, g)) == [("group7", "a", 3, 10)]
    f = put(tmp_path, "cor.txt", "c:1:5-9\n")
    assert rows(text.corrected_names(spark, f)) == [("c:1:5-9", "c:1", 5, 9)]


def test_clm_round_trip(spark, tmp_path):
    p = spark.createDataFrame([("r1", "a", 1, "b", 2), ("r2", "a", 3, "b", 4)], "read_id string, ctg_i string, pos_i long, ctg_j string, pos_j long")
    c = spark.createDataFrame([("a", 10, 1), ("b", 20, 1)], "ctg string, len long, grp long")
    d = links.orientation_distances(p, c)
    out = str(tmp_path / "clm")
    sinks.write_lines(sinks.clm_lines(d), out)
    got = {(r.ori_i, r.ori_j): (r.links, r.distances) for r in text.clm(spark, out).collect()}
    assert got["+", "+"] == (4, [11, 11, 11, 11]) and got["-", "-"] == (4, [19, 19, 19, 19])
    assert sinks.split_by_group(d, c).count() == 4


def test_fastq_alleles_bed_sam(spark, tmp_path):
    q = put(tmp_path, "x.fq", "@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+\nII\n")
    assert rows(text.fastq(spark, q), "name") == [("r1 x", "ACGT", "IIII"), ("r2", "AC", "II")]
    a = put(tmp_path, "al.txt", "Number Chrom Ref_coord Ref_base hap_1 hap_2\n1 chr1 5 A A -\n")
    assert rows(text.alleles(spark, a)) == [("chr1", 5, "A", ["A", "-"])]
    b = put(tmp_path, "x.bed", "c\t1\t2\tn\t255\t.\n")
    assert rows(text.bed(spark, b)) == [("c", 1, 2, "n", "255", ".")]
    s = put(tmp_path, "x.sam", "@HD\tVN:1\nr\t65\ta\t5\t60\t4M\t=\t9\t0\tACGT\tIIII\tNM:i:1\tNM:i:2\n")
    assert rows(text.sam(spark, s).select("qname", "flag", "ref", "pos", "mref", "mpos", "nm")) == [("r", 65, "a", 4, "a", 8, 2)]
    assert text.detected("a/B.PAIRS.gz") == "pairs"
    with pytest.raises(ValueError):
        text.detected("x.docx")


def block(raw):
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(raw), len(raw))


def bam(path, order, recs):
    text_ = f"@HD\tVN:1.6\tSO:{order}\n".encode()
    raw = b"BAM\1" + struct.pack("<i", len(text_)) + text_ + struct.pack("<i", 2)
    for n, size in (("a", 100), ("b", 200)):
        raw += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size)
    for name, flag, ref, pos, mapq, mref, mpos in recs:
        n = name.encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(n), mapq, 0, 1, flag, 4, mref, mpos, 0) + n + struct.pack("<I", 4 << 4) + b"\x11\x11" + b"\xff" * 4 + b"NMC\x03" + b"RGZx\0" + b"ASs\x05\0"
        raw += struct.pack("<i", len(body)) + body
    path.write_bytes(block(raw[:50]) + block(raw[50:]) + block(b""))


def test_bam(spark, tmp_path):
    bam(tmp_path / "x.bam", "unsorted", [("r1", 65, 0, 5, 60, 1, 7), ("r2", 65, 1, 9, 3, 0, 1), ("r3", 129, 0, 2, 50, 0, 4)])
    spark.dataSource.register(BamSource)
    df = spark.read.format("bam").option("path", str(tmp_path / "x.bam")).option("allBits", 64).load()
    assert [(r.qname, r.ref, r.pos, r.mref, r.mpos, r.cigar, r.nm, r.score) for r in df.orderBy("qname").collect()] == [("r1", "a", 5, "b", 7, "4M", 3, 5), ("r2", "b", 9, "a", 1, "4M", 3, 5)]
    assert [r.qname for r in df.where("mapq >= 30").collect()] == ["r1"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pushed = spark.read.format("bam").option("path", str(tmp_path / "x.bam")).option("pushFilters", True).load().where("mapq >= 30")
    assert sorted(r.qname for r in pushed.collect()) == ["r1", "r3"]
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    bam(tmp_path / "y.bam", "coordinate", [])
    with pytest.raises(Exception, match="sorted by coordinate"):
        spark.read.format("bam").option("path", str(tmp_path / "y.bam")).option("refuseSorted", True).load().collect()


def test_matrix_cache(spark, tmp_path):
    m = spark.createDataFrame([(0, 1, 5)], "i long, j long, n long")
    sinks.write_matrix(m, str(tmp_path / "m"), bin_size=500, md5="x")
    assert rows(sinks.read_matrix(spark, str(tmp_path / "m"), bin_size=500, md5="x")) == [(0, 1, 5)]
    with pytest.raises(ValueError):
        sinks.read_matrix(spark, str(tmp_path / "m"), bin_size=100, md5="x")


def test_streamed_links_equal_batch(spark, tmp_path):
    from strandweave.operators import pairs as P
    from strandweave.streaming import links as S

    frame = spark.createDataFrame([(str(k), f"c{k % 3}", k, f"c{k % 4}", k + 1) for k in range(40)], S.PAIRS)
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    q = S.to_memory(S.running_links(S.from_folder(spark, str(tmp_path / "in"))), "running", str(tmp_path / "cp"))
    q.awaitTermination()
    want = P.between_contigs(P.canonical(frame)).groupBy("ctg_i", "ctg_j").count()
    assert rows(spark.table("running"), "ctg_i", "ctg_j") == rows(want, "ctg_i", "ctg_j")
