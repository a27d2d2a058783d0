"""The filter chain's hard cutoff, interval sets on small inputs, and the gate of groups without alignments."""

import pytest

from strandweave.operators import chain, reads


def spans(spark, *rows):
    return spark.createDataFrame([("a", *r) for r in rows], "k string, start long, end long")


def listed(df):
    return sorted((r.start, r.end) for r in df.collect())


def test_interval_sets(spark):
    a, b = spans(spark, (0, 10), (5, 12), (12, 15), (20, 30), (40, 40)), spans(spark, (3, 4), (14, 22), (29, 50))
    union = chain.interval_union(a, "k")
    assert listed(union) == [(0, 15), (20, 30)]
    assert listed(chain.interval_difference(a, b, "k")) == [(0, 3), (4, 14), (22, 29)]
    sizes = spark.createDataFrame([("a", 35), ("b", 7)], "k string, size long")
    assert listed(chain.interval_complement(union, sizes, "k")) == [(0, 7), (15, 20), (30, 35)]
    assert listed(chain.interval_hull(a, "k")) == [(0, 40)]


def test_chain_keeps_the_wanted(spark):
    contigs = spark.createDataFrame([(f"c{k}", 100 - k, 10 + k) for k in range(20)], "ctg string, len long, re_sites long")
    full = spark.createDataFrame([(f"c{i}", f"c{j}", 1 + (i * j) % 5) for i in range(20) for j in range(i + 1, 20)], "ctg_i string, ctg_j string, links long")
    wanted = contigs.where("ctg = 'c19'")
    c = chain.Chain(nx=70, sites=12, low=0, high=99, rank_sum=10**6)
    got = {r.ctg for r in chain.filter_fragments(contigs, full, wanted, c).collect()}
    assert got == {f"c{k}" for k in range(3, 14)} | {"c19"}


def test_groups_without_alignments_raise(spark):
    groups = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "grp long, ctg string")
    paf = spark.createDataFrame([("a",), ("c",)], "qname string")
    assert reads.require_alignments(groups, paf).count() == 3
    with pytest.raises(Exception, match="no alignment for group 2"):
        reads.require_alignments(groups, paf.where("qname = 'a'")).collect()
