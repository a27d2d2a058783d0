"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import backoff_lm, license_scan, pairwise_rank, secret_automaton, simhash_dedup, source_mixing, swap_packing, token_quality, toxic_neighbours, vptree
from strandweave.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_token_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_quality.quality(table(spark, sf_dir, "documents"))


def op3_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE_OP3 = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def digest_spans(found: DataFrame) -> DataFrame:
    """The columns of the secrets contract from (doc_id, spans)."""
    base = F.filter("spans", lambda s: s.kind.isin(*secret_automaton.BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in secret_automaton.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_spans(secret_automaton.scan(table(spark, sf_dir, "documents")))


def op5_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairwise_rank.rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_lm.score_documents(table(spark, sf_dir, "documents"))
    return scored.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


def stupid_backoff_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 6 with two words of context; the SQL of op6_stupid_backoff has one."""
    scored = backoff_lm.score_documents(table(spark, sf_dir, "documents"), backoff_lm.Backoff(order=3))
    return scored.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_log_score")})


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "draws", "shards")


def op8_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return swap_packing.pack(table(spark, sf_dir, "documents"))


def op9_toxic_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_neighbours.rate_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_token_fertility": op2_token_fertility,
    "op3_vantage_point_search": op3_vantage_point_search,
    "op4_secret_scan": op4_secret_scan,
    "op5_pairwise_quality": op5_pairwise_quality,
    "op6_stupid_backoff": op6_stupid_backoff,
    "stupid_backoff_3": stupid_backoff_3,
    "op7_source_mixing": op7_source_mixing,
    "op8_swap_packing": op8_swap_packing,
    "op9_toxic_neighbours": op9_toxic_neighbours,
    "op10_simhash_dedup": op10_simhash_dedup,
}
ORACLES: dict[str, str] = {"op1_license_scan": license_scan.ORACLE, "op3_vantage_point_search": ORACLE_OP3, "op6_stupid_backoff": backoff_lm.ORACLE}
