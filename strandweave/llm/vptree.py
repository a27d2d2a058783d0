"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

Largest inner product is nearest Euclidean distance after x -> (x, sqrt(M^2 - |x|^2)) with M the shard's largest norm
and queries scaled to length M, so the triangle inequality holds and prunes. A branch is left out if its nearest
possible point is farther than ``factor`` times the distance of the k-th neighbour known so far: factor 1 is exact,
less visits fewer branches. Whole blocks of queries descend one tree together, so each node is one matrix product. Where
a shard's first queries show that its tree leaves out little, the others scan the shard in large blocks, which is exact too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.common import materialise


@dataclass(frozen=True)
class Search:
    """k neighbours; pruning factor; most vectors of a shard and queries of a block, whose copies a task holds (some 32 MB each at
    64 dimensions); vectors per leaf; shards that small tables are dealt to, each of ``least_rows`` vectors or more."""

    k: int = 20
    factor: float = 1.0
    shard_rows: int = 65_536
    block_rows: int = 65_536
    leaf: int = 32
    least_shards: int = 24
    least_rows: int = 256
    trial: int = 64
    useless: float = 0.5

    def shards(self, n: int) -> int:
        return max(1, math.ceil(n / self.shard_rows), min(self.least_shards, n // self.least_rows))


def exact_scores(q: np.ndarray, a: np.ndarray, x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows ``a`` of q and ``b`` of x, summed in order of components, so equal vectors tie exactly."""
    out = np.zeros(len(a))
    for c in range(q.shape[1]):
        out += q[a, c] * x[b, c]
    return out


class Tree:
    """A vantage-point tree over the rows of ``points`` (already in the metric space)."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf = points, leaf
        self.order = np.arange(len(points))
        self.root = self._grow(0, len(points))

    def _grow(self, lo: int, hi: int):
        if hi - lo <= self.leaf:
            return (lo, hi)
        rows = self.order[lo:hi]
        pick = rows[np.argmax(((self.points[rows] - self.points[rows].mean(0)) ** 2).sum(1))]  # an outlier: distances to it differ most
        d = np.sqrt(np.maximum(((self.points[rows] - self.points[pick]) ** 2).sum(1), 0))
        by = np.argsort(d, kind="stable")
        self.order[lo:hi] = rows[by]
        mid = (lo + hi) // 2
        d = d[by]
        near, far = (d[0], d[mid - lo - 1]), (d[mid - lo], d[-1])
        return (pick, near, far, self._grow(lo, mid), self._grow(mid, hi))

    def search(self, queries: np.ndarray, best: "Best", factor: float) -> None:
        """Offers ``best`` all rows that pruning at ``factor`` doesn't leave out."""
        stack = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while stack:
            node, at, bound = stack.pop()
            keep = bound <= best.reach(at) * factor
            at, bound = at[keep], bound[keep]
            if not len(at):
                continue
            if len(node) == 2:
                best.offer(at, self.order[node[0] : node[1]])
                continue
            pick, near, far, inner, outer = node
            d = np.sqrt(np.maximum(((queries[at] - self.points[pick]) ** 2).sum(1), 0))
            gap = [np.maximum(bound, np.maximum(d - hi, lo - d)) for lo, hi in (near, far)]
            first = gap[0] <= gap[1]
            # each query's nearer branch first, or that of most of few queries (smaller blocks cost more than they leave out)
            parts = [(first, 0), (~first, 1)] if len(at) >= 64 else [(slice(None), int(first.sum() * 2 < len(at)))]
            for mine, near_ in parts:
                far_ = 1 - near_
                stack += [((inner, outer)[k], at[mine], gap[k][mine]) for k in (far_, near_)]


class Best:
    """The k best rows of every query so far, by inner product, ties to the smaller id.

    The last bits of a matrix product depend on the place in the matrix, so it only picks the rows that may be among the
    k best, within ``slack`` (its rounding); these are scored exactly before any is left out.
    """

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, bound2: float):
        self.q, self.q_ids, self.x, self.x_ids, self.k, self.bound2 = q, q_ids, x, x_ids, k, bound2
        self.norm = np.sqrt((q**2).sum(1))
        self.slack = 8 * (q.shape[1] + 2) * np.finfo(float).eps * math.sqrt(bound2) * self.norm
        self.score = np.full((len(q), k), -np.inf)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.evaluated = 0  #: pairs of a query and a vector

    def reach(self, at: np.ndarray) -> np.ndarray:
        """Distance, in the metric space, of the k-th best; a little more, for rounding."""
        kth = self.score[at, self.k - 1]
        m = math.sqrt(self.bound2)
        with np.errstate(invalid="ignore"):
            d2 = np.where(np.isneginf(kth), np.inf, 2 * self.bound2 - 2 * m * kth / self.norm[at])
        return np.sqrt(np.maximum(d2, 0)) + 1e-7 * m

    def offer(self, at: np.ndarray, rows: np.ndarray) -> None:
        score = self.q[at] @ self.x[rows].T
        self.evaluated += score.size
        floor = self.score[at, -1]
        if len(rows) > self.k and np.isneginf(floor).any():  # one more than k, since the query's own row may be among them
            floor = np.maximum(floor, np.partition(score, len(rows) - self.k - 1, axis=1)[:, len(rows) - self.k - 1])
        row, col = np.divmod(np.flatnonzero(score >= (floor - self.slack[at])[:, None]), len(rows))
        other = self.x_ids[rows[col]] != self.q_ids[at[row]]
        row, col = row[other], col[other]
        if not len(row):
            return
        some, first, count = np.unique(row, return_index=True, return_counts=True)
        put = np.repeat(np.arange(len(some)), count), np.arange(len(row)) - np.repeat(first, count)
        exact = np.full((len(some), count.max()), -np.inf)
        ids = np.full(exact.shape, np.iinfo(np.int64).max)
        exact[put] = exact_scores(self.q, at[row], self.x, rows[col])
        ids[put] = self.x_ids[rows[col]]
        at = at[some]
        score, ids = np.hstack([self.score[at], exact]), np.hstack([self.ids[at], ids])
        by = np.lexsort((ids, -score), axis=1)[:, : self.k]
        self.score[at], self.ids[at] = np.take_along_axis(score, by, 1), np.take_along_axis(ids, by, 1)

    def scan(self) -> None:
        """Offers all rows to all queries, in blocks."""
        for lo in range(0, len(self.x), 4096):
            rows = np.arange(lo, min(lo + 4096, len(self.x)))
            for first in range(0, len(self.q), 512):
                self.offer(np.arange(first, min(first + 512, len(self.q))), rows)


def search_shard(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, s: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query id, vector id, score) of the k best rows of one shard for one block of queries, and how many pairs were evaluated."""
    bound2 = float((x**2).sum(1).max()) * (1 + 1e-12)
    m = math.sqrt(bound2)
    lift = lambda v, last: np.hstack([v, last[:, None]])
    tree = Tree(lift(x, np.sqrt(np.maximum(bound2 - (x**2).sum(1), 0))), s.leaf)
    out: list[tuple] = []
    evaluated = 0
    starts = [0, *range(s.trial, len(q), 4096)]
    for lo, hi in zip(starts, [*starts[1:], len(q)], strict=True):  # the tree stands, queries pass through it
        own, own_ids = q[lo:hi], q_ids[lo:hi]
        best = Best(own, own_ids, x, x_ids, s.k, bound2)
        if lo and evaluated > s.useless * lo * len(x):
            best.scan()
        else:
            tree.search(lift(own * (m / best.norm)[:, None], np.zeros(len(own))), best, s.factor)
        row, rank = np.nonzero(np.isfinite(best.score))
        out.append((own_ids[row], best.ids[row, rank], best.score[row, rank]))
        evaluated += best.evaluated
    return (*(np.concatenate(c) for c in zip(*out, strict=True)), evaluated)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part: no null, non-finite or all-zero vector, no null id."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & some)


def nearest(vectors: DataFrame, is_query, s: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of every query row, nearest first, ties to the smaller vec_id.

    ``is_query`` is a condition on vec_id. Vectors of differing length only meet their own length. Null, zero and
    non-finite vectors take no part; fewer candidates than k give all of them; a table without vectors or queries gives
    no row; a vec_id that comes more than once counts once, with its first vector in order of components; other columns
    are ignored, whatever their names.
    """
    own = materialise(valid_vectors(vectors).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("width", F.size("embedding")))
    n, nq = own.agg(F.count("*"), F.count_if(is_query)).first()
    shards = s.shards(n)
    blocks = max(1, math.ceil((nq or 0) / s.block_rows))
    of = lambda m, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    base = own.select("vec_id", "embedding", "width", of(shards, 1).alias("shard")).withColumn("block", numbers(blocks))
    asked = own.where(is_query).select("vec_id", "embedding", "width", of(blocks, 2).alias("block")).withColumn("shard", numbers(shards))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        a, b, c, _ = search_shard(left.vec_id.to_numpy(), np.stack(left.embedding.to_numpy()), right.vec_id.to_numpy(), np.stack(right.embedding.to_numpy()), s)
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    key = ["shard", "block", "width"]
    found = asked.groupBy(key).cogroup(base.groupBy(key)).applyInPandas(search, "query_id long, vec_id long, score double")

    # a query has k rows of each shard; Spark keeps the k best of each task before they are dealt out, and then of all
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
