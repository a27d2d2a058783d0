"""Seeded generators with known truth: contigs, haplotypes, chimeras, collapsed regions, switch errors, wrong groups.

Randomness is a hash of (seed, key), so results depend neither on partitions nor on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chance(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that the keys fix."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def _rng(seed: int, name: str) -> np.random.Generator:
    return np.random.default_rng([seed, *name.encode()])


_TURN = str.maketrans("ACGTacgt", "TGCAtgca")


def contigs(chromosomes: DataFrame, mean: int, cv: float, seed: int = 12345, least: int = 1) -> DataFrame:
    """(name, seq): chromosomes (name, seq) cut to pieces of normally distributed lengths, strands at random.

    Names hold the truth: <chrom>_0_<n>_<start>_<end>_<orient>_<len>, 1-based and closed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, seq in pdf[["name", "seq"]].itertuples(index=False):
                rng, at, n = _rng(seed, name), 0, 0
                while at < len(seq):
                    end = min(len(seq), at + max(least, round(rng.normal(mean, mean * cv))))
                    n += 1
                    turn = rng.random() < 0.5
                    piece = seq[at:end].translate(_TURN)[::-1] if turn else seq[at:end]
                    rows.append((f"{name}_0_{n}_{at + 1}_{end}_{'-' if turn else '+'}_{end - at}", piece))
                    at = end
            yield pd.DataFrame(rows, columns=["name", "seq"])

    return chromosomes.select("name", "seq").mapInPandas(run, "name string, seq string")


def haplotypes(chromosomes: DataFrame, ploidy: int, divergence: float, seed: int = 12345, insertions: float = 0.1, deletions: float = 0.1, transitions: float = 0.67) -> DataFrame:
    """(name, hap, seq, n_sub, n_ins, n_del): copies of chromosomes that differ at a share of their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, far = dict(zip("ACGT", "GTAC", strict=True)), dict(zip("ACGT", ("CT", "AG", "CT", "AG"), strict=True))
        for pdf in batches:
            rows = []
            for name, seq in pdf[["name", "seq"]].itertuples(index=False):
                for hap in range(1, ploidy + 1):
                    rng = _rng(seed + hap, name)
                    out, counts = list(seq), [0, 0, 0]
                    for k in np.flatnonzero(rng.random(len(seq)) < divergence):
                        c, kind = seq[k].upper(), rng.random()
                        if c not in near:
                            continue
                        if kind < insertions:
                            out[k] = seq[k] + "ACGT"[rng.integers(4)]
                            counts[1] += 1
                        elif kind < insertions + deletions:
                            out[k] = ""
                            counts[2] += 1
                        else:
                            out[k] = near[c] if rng.random() < transitions else far[c][rng.integers(2)]
                            counts[0] += 1
                    rows.append((name, hap, "".join(out), *counts))
            yield pd.DataFrame(rows, columns=["name", "hap", "seq", "n_sub", "n_ins", "n_del"])

    return chromosomes.select("name", "seq").mapInPandas(run, "name string, hap int, seq string, n_sub long, n_ins long, n_del long")


def chimeras(parts: DataFrame, share: float, seed: int = 12345) -> DataFrame:
    """(name, seq): pairs of contigs joined to one for about ``share`` of them; partners stand next to each other in hash order of their bucket."""
    picked = parts.withColumn("hit", chance(seed, F.col("name")) < share)
    n = picked.where("hit").withColumn("r", F.row_number().over(_by_bucket(seed))).withColumn("b", _bucket(seed))
    left = n.where("r % 2 = 1").select("b", F.floor((F.col("r") - 1) / 2).alias("k"), F.col("name").alias("n1"), F.col("seq").alias("s1"))
    right = n.where("r % 2 = 0").select("b", F.floor((F.col("r") - 1) / 2).alias("k"), F.col("name").alias("n2"), F.col("seq").alias("s2"))
    joined = left.join(right, ["b", "k"], "left")
    both = F.concat(F.lit("chimeric|"), "n1", F.lit("|"), "n2")
    out = joined.select(F.when(F.col("n2").isNull(), F.col("n1")).otherwise(both).alias("name"), F.concat("s1", F.coalesce("s2", F.lit(""))).alias("seq"))
    return out.unionByName(picked.where("not hit").select("name", "seq"))


def _bucket(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), "name"), F.lit(64))


def _by_bucket(seed: int):
    from pyspark.sql.window import Window

    return Window.partitionBy(_bucket(seed)).orderBy(chance(seed + 2, F.col("name")), "name")


def switch_errors(alleles: DataFrame, rate: float, seed: int = 12345) -> DataFrame:
    """Variants (chrom, pos, ref, alleles) whose first two haplotypes are swapped at about ``rate`` of the places; adds switched."""
    hit = (chance(seed, F.col("chrom"), F.col("pos")) < rate) & (F.size("alleles") >= 2)
    swapped = F.concat(F.array(F.col("alleles")[1], F.col("alleles")[0]), F.slice("alleles", 3, F.greatest(F.size("alleles") - 2, F.lit(1))))
    return alleles.withColumn("switched", hit).withColumn("alleles", F.when(F.col("switched"), swapped).otherwise(F.col("alleles")))


def wrong_groups(assigned: DataFrame, n_groups: int, wrong: float, missing: float, seed: int = 12345) -> DataFrame:
    """(ctg, grp, truth): groups 0..n_groups-1 of which some contigs move to another group and some to none."""
    c = chance(seed, F.col("ctg"))
    other = (F.col("grp") + 1 + F.pmod(F.xxhash64(F.lit(seed + 3), "ctg"), F.lit(max(1, n_groups - 1)))) % n_groups
    grp = F.when(c < wrong, other).when(c < wrong + missing, F.lit(None)).otherwise(F.col("grp"))
    return assigned.select("ctg", grp.cast("long").alias("grp"), F.col("grp").cast("long").alias("truth"))


def split_at_gaps(seqs: DataFrame, least: int = 1) -> DataFrame:
    """(name, n, seq): stretches of sequence between runs of at least ``least`` N."""
    parts = F.filter(F.split("seq", f"N{{{least},}}"), lambda x: x != "")
    return seqs.select("name", F.posexplode(parts).alias("p", "seq")).select("name", (F.col("p") + 1).alias("n"), "seq")


def sampled(rows: DataFrame, share: float, key: str, seed: int = 12345) -> DataFrame:
    return rows.where(chance(seed, F.col(key)) < share)
