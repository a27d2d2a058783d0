"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source's documents stand in a pseudo-random order that depends on the seed, doc_id and text alone. Running word
   counts along it (prefix sums in two levels, so no task ever holds a source) cut it into blocks of equal words.
2. The target weights give each source an exact quota of block draws: whole passes, which draw every block, and a last
   pass, which draws some blocks and skips the others.
3. A binary tree over the output shards splits the vector of quotas (draws of whole passes, draws and skips of the last):
   each node deals its share to its two halves by a multivariate hypergeometric draw, so the leaves hold exact quotas that
   add up to the root's.
4. A shard's blocks are consecutive positions of a fixed permutation of its source's blocks, hence disjoint from other
   shards'; of those of the last pass it draws as many as its leaf says, by a permutation of its own. Within a shard,
   documents are ordered by a hash (the local shuffle).

Everything that is gathered on the driver is per source (names, sizes, quotas), never per document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.common import WORD

HASH_BITS = 60
CYCLE = (1, 2, 3)


@dataclass(frozen=True)
class Mix:
    """Parameters: at most ``most`` passes over a source; blocks per source; output shards; seed of order and tree."""

    weights: tuple[int, ...] = CYCLE
    most: int = 3
    blocks: int = 4096
    shards: int = 64
    buckets: int = 4096
    seed: int = 20240229


@dataclass
class Quota:
    """A source's draws of blocks, and running totals by shard: draws of whole passes, of the last pass, and blocks it skips."""

    source: str | None
    size: int
    target: float
    draws: int = 0
    whole: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    skipped: list[int] = field(default_factory=list)


def targets(sizes: list[int], weights: list[float], most: int) -> list[float]:
    """Shares of the sum of sizes by weight; what is above ``most`` times its size stops there, the excess goes to the rest."""
    out, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        total = sum(weights[k] for k in sorted(free))
        share = {k: left * weights[k] / total for k in free}
        over = [k for k in sorted(free) if share[k] > most * sizes[k]]
        if not over:
            for k in free:
                out[k] = share[k]
            break
        for k in over:
            out[k] = float(most * sizes[k])
            left -= out[k]
            free.discard(k)
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(source, shard) counts of draws: every node splits its vector among its halves, in proportion to their leaves."""
    out = np.zeros((len(quotas), shards), np.int64)

    def deal(node: int, lo: int, hi: int, counts: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = counts
            return
        mid, total = (lo + hi) // 2, int(counts.sum())
        left = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, node])
        taken, pool = np.zeros_like(counts), total
        for k, c in enumerate(counts):  # one hypergeometric draw for each source is the multivariate one, and has no bound on the counts' sum
            pool -= int(c)
            n = left - int(taken[:k].sum())
            if n and c:
                taken[k] = min(int(c), n) if pool == 0 else _hypergeometric(rng, int(c), pool, n)
        deal(2 * node, lo, mid, taken)
        deal(2 * node + 1, mid, hi, counts - taken)

    deal(1, 0, shards, np.asarray(quotas, np.int64))
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    p = good / (good + bad)  # beyond the generator's range: its normal limit, within the exact support
    sd = math.sqrt(n * p * (1 - p) * (good + bad - n) / (good + bad - 1))
    return int(min(max(round(rng.normal(n * p, sd)), n - bad, 0), good, n))


def plan(sizes: list[tuple[str | None, int]], mix: Mix) -> list[Quota]:
    """Quotas of all sources; sources by code point, null last, weigh as ``mix.weights`` repeats."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weights = [mix.weights[k % len(mix.weights)] for k in range(len(order))]
    quotas = [Quota(s, n, t) for (s, n), t in zip(order, targets([n for _, n in order], weights, mix.most), strict=True)]
    for q in quotas:
        q.draws = min(round(q.target * mix.blocks / q.size), mix.most * mix.blocks) if q.size else 0
    rest = [q.draws % mix.blocks for q in quotas]
    dealt = splitting_tree([q.draws - r for q, r in zip(quotas, rest, strict=True)] + rest, mix.shards, mix.seed)
    left = splitting_tree([mix.blocks - r for r in rest], mix.shards, mix.seed + 1)
    for k, q in enumerate(quotas):
        q.whole, q.last, q.skipped = ([int(x) for x in np.cumsum(row)] for row in (dealt[k], dealt[len(quotas) + k], left[k]))
    return quotas


def position(docs_key: list[Column], seed: int) -> Column:
    """60 hash bits of a document; nulls have a place as well."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(c.cast("string"), F.lit("null")) for c in docs_key))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _permuted(k: Column, n: Column, seed: Column) -> Column:
    """An affine permutation of 0..n-1; the factor is a prime beyond any n, hence coprime to it."""
    return F.pmod(k * F.lit(2_147_483_647) + seed, n)


def _drawn(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with the struct column ``mixed_``: size, source_size, target, draws, shards, local_order.

    One exchange by (source, bucket of the order) carries the rows: the running sums, and the join with what stands before
    each bucket, both use it.
    """
    spark = docs.sparkSession
    shift = HASH_BITS - int(math.log2(mix.buckets))
    key = [F.col("doc_id"), F.xxhash64("text")]
    name = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    own = F.struct(
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), position(key, mix.seed).alias("place"),
        position(key, mix.seed + 1).alias("local_order"),
    )
    sized = docs.withColumns({"mixed_": own, "mixed_source_": name})
    sized = sized.withColumn("mixed_bucket_", F.shiftright("mixed_.place", shift))
    per_bucket = sized.groupBy("mixed_source_", "mixed_bucket_").agg(F.sum("mixed_.size").alias("n"))
    per_source = per_bucket.groupBy("mixed_source_").agg(F.sum("n").alias("n")).collect()
    quotas = plan([(None if r.mixed_source_ == "null" else r.mixed_source_[1:], r.n) for r in per_source], mix)
    rows = [("null" if q.source is None else f"={q.source}", (q.size, q.target, q.draws, q.whole, q.last, q.skipped)) for q in quotas]
    of_source = spark.createDataFrame(rows, "mixed_source_ string, mixed_q_ struct<size:long,target:double,draws:long,whole:array<long>,last:array<long>,skipped:array<long>>")
    by_source = Window.partitionBy("mixed_source_").orderBy("mixed_bucket_").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select("mixed_source_", "mixed_bucket_", F.coalesce(F.sum("n").over(by_source), F.lit(0)).alias("mixed_before_"))
    in_bucket = Window.partitionBy("mixed_source_", "mixed_bucket_").orderBy("mixed_.place", "doc_id", "mixed_.size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("mixed_ahead_", F.coalesce(F.sum("mixed_.size").over(in_bucket), F.lit(0)))
    placed = placed.join(before, ["mixed_source_", "mixed_bucket_"]).join(F.broadcast(of_source), "mixed_source_")  # a row for each source
    q, blocks = F.col("mixed_q_"), F.lit(mix.blocks).cast("long")
    middle = F.col("mixed_before_") + F.col("mixed_ahead_") + F.col("mixed_.size") / 2
    block = F.least(F.floor(middle * mix.blocks / F.greatest(q["size"], F.lit(1))), blocks - 1).cast("long")
    passes = F.floor(q["draws"] / blocks).cast("long")
    shard = lambda ends, at: F.size(F.filter(ends, lambda x: x <= at))
    of_pass = lambda k: shard(q["whole"], _permuted(k * blocks + block, passes * blocks, F.lit(mix.seed)))
    whole = F.when(passes > 0, F.transform(F.sequence(F.lit(0).cast("long"), passes - 1), of_pass)).otherwise(F.array().cast("array<int>"))
    ends = F.transform(F.arrays_zip(q["last"], q["skipped"]), lambda x: x["last"] + x["skipped"])
    at = _permuted(block, blocks, F.lit(mix.seed + 2))
    pool = shard(ends, at)
    begin = lambda x: F.coalesce(F.get(x, pool - 1), F.lit(0))
    quota = F.get(q["last"], pool) - begin(q["last"])
    picked = _permuted(at - begin(ends), F.get(ends, pool) - begin(ends), F.lit(mix.seed + 3) + pool) < quota
    shards = F.array_sort(F.concat(whole, F.when((q["draws"] > 0) & picked, F.array(pool)).otherwise(F.array().cast("array<int>"))))
    out = F.struct(F.col("mixed_.size").alias("size"), q["size"].alias("source_size"), q["target"].alias("target"), F.size(shards).alias("draws"), shards.alias("shards"), F.col("mixed_.local_order").alias("local_order"))
    return placed.select(*[placed[c] for c in docs.columns], out.alias("mixed_"))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, draws, taken, shards, local_order.

    size counts the words of the whole text (null: 0); draws is how often the mix takes the document, once in each of
    ``shards`` (sorted; a shard may come twice), taken = size * draws. Documents without words follow their block like
    others. Rows with equal doc_id and text share their place in the order, so they are taken alike up to the border of a
    block. A null source is a source of its own, a null doc_id a document. An empty table gives no row; other columns
    are ignored, whatever their names. A source without a single word has target 0 and is not taken.
    """
    own = _drawn(docs.select("doc_id", "source", "text"), mix)
    return own.select("doc_id", "source", "mixed_.size", "mixed_.source_size", "mixed_.target", "mixed_.draws", (F.col("mixed_.size") * F.col("mixed_.draws")).alias("taken"), "mixed_.shards", "mixed_.local_order")


def apply_mix(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs``, each as often as the mix draws it, by shard and in each shard's local order; columns stay as they are.

    Each row has its own decision, also among rows that share a doc_id or have none; texts of any length count as a whole,
    null and empty ones follow their block; an empty table gives none; columns of any other name pass (but those that begin
    with ``mixed_``, which must not be there).
    """
    copies = _drawn(docs, mix).withColumn("mixed_shard_", F.explode("mixed_.shards"))
    return copies.repartition("mixed_shard_").sortWithinPartitions("mixed_shard_", "mixed_.local_order").select(*docs.columns)
