"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from strandweave.llm import backoff_lm, license_scan, pairwise_rank, secret_automaton, simhash_dedup, source_mixing, swap_packing, token_quality, toxic_neighbours, vptree

LONG = "word number é " * 60_000
WORDS = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood near town"
ROWS = [
    (1, WORDS, "en", "a"), (2, WORDS, None, None), (3, None, "en", "a"), (4, "", "fr", "b"), (5, " \n\t ", "en", None), (6, LONG, "en", "b"),
    (7, "short", "en", "a"), (7, "short", "en", "a"), (None, WORDS + " again", "en", "a"), (8, WORDS.upper(), None, "c"), (9, "password = hunter22 日本語 🙂", "ja", "c"),
]
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, label int, score double, kept boolean, cid long, size long, n int, length int, draws int, chunk int, spans string, digest string"


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, None, *(None,) * 11) for r in rows], EXTRA)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None), (8, 0, 1), (None, 1, 1), (6, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")


OPS = {
    "license": lambda s, d: license_scan.scan(d),
    "tokens": lambda s, d: token_quality.quality(d),
    "secrets": lambda s, d: secret_automaton.scan(d),
    "redact": lambda s, d: secret_automaton.redact(d),
    "rank": lambda s, d: pairwise_rank.rank_quality(d, labels(s)),
    "backoff": lambda s, d: backoff_lm.score_documents(d),
    "mix": lambda s, d: source_mixing.mix_sources(d),
    "toxic": lambda s, d: toxic_neighbours.rate_toxicity(d, labels(s)),
}


@pytest.mark.parametrize("name", OPS)
def test_one_row_for_each_row(spark, name):
    got = OPS[name](spark, frame(spark)).select("doc_id").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, name):
    assert OPS[name](spark, frame(spark).limit(0)).collect() == []


def test_pack(spark):
    got = swap_packing.pack(frame(spark)).toPandas()
    assert got.doc_id.isna().sum() == 1 and (got.doc_id == 7).sum() == 2
    assert swap_packing.pack(frame(spark).limit(0)).collect() == []


def test_dedup(spark):
    got = {(r.doc_id, r.cluster_id, r.keep) for r in simhash_dedup.near_duplicates(frame(spark)).collect()}
    assert (1, 1, True) in got and (2, 1, False) in got
    assert {(3, 3, True), (4, 3, False), (5, 3, False)} <= got
    assert (None, 1, False) in got and {x[0] for x in got} == {None, *range(1, 10)}
    kept = simhash_dedup.representatives(frame(spark)).collect()
    assert sorted((r.doc_id or 0) for r in kept) == [1, 3, 6, 7, 8, 9]
    assert simhash_dedup.near_duplicates(frame(spark).limit(0)).collect() == []


def test_vectors(spark):
    v = [1.0, 2.0]
    rows = [(0, v, 1), (1, v, 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, None], 1), (6, [2.0, 1.0], 1), (6, [2.0, 1.0], 2), (None, v, 1), (20, [-1.0, 0.5], 0), (7, [1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = [tuple(r) for r in vptree.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5.0), (0, 2, 6, 4.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 6, -1.5)]
    assert vptree.nearest(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_nothing_to_learn_from(spark):
    none = labels(spark).limit(0)
    assert {r.score for r in pairwise_rank.rank_quality(frame(spark), none).collect()} == {0.5}
    assert {r.score for r in toxic_neighbours.rate_toxicity(frame(spark), none).collect()} == {0.0}
