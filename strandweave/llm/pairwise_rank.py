"""Quality classifier: a Bradley-Terry ranking learnt from preference pairs by logistic loss on feature differences.

A document of label 1 is preferred to one of label 0; all pairs of all rows that may be learnt from take part. A pair's loss
depends on the difference of two scores only, so counts and feature sums along a grid of scores, between whose points each row
is shared out, give the sums over all pairs in one pass over the rows. The features describe the form of the whole text. The
ranking score w.x has no natural zero, so the threshold is a quantile of the scores: the share of label 0 among the rows that
may be learnt from. The returned score is a logistic curve through 0.3 at that threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import held_out, materialise
from strandweave.llm.textkernel import pieces, text_buffer
from strandweave.llm.textstats import stats


@dataclass(frozen=True)
class Ranking:
    """Points of the grid of scores; tasks of a pass, whose sums the driver adds; ridge; Newton steps; score at the threshold."""

    grid: int = 512
    tasks: int = 32
    ridge: float = 1e-3
    steps: int = 25
    at_threshold: float = 0.3


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """(texts, features): shares between 0 and 1 with their roots, which tell small shares apart, and sizes on a log scale."""
    chars, words, lines = np.maximum(s["chars"], 1), np.maximum(s["n_words"], 1), np.maximum(s["n_lines"], 1)
    letters = np.maximum(s["upper"] + s["lower"], 1)
    shares = np.column_stack([
        s["n_symbols"] / chars, s["pipe"] / chars, s["bang"] / chars, s["punct"] / chars, s["digit"] / chars, s["stop"] / words,
        s["upper"] / letters, s["n_dup_lines"] / lines, s["n_repeat_words"] / words, 1 - s["n_distinct"] / words, s["n_marked"] / words,
    ])
    sizes = np.column_stack([np.log1p(s["n_words"]), np.log1p(s["n_words"] / lines), s["word_chars"] / words / 10, 1 / (1 + s["n_words"])])
    shares = np.minimum(shares, 1)
    return np.hstack([shares, np.sqrt(shares), sizes])


N_FEATURES = 26


def feature_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for lo, hi in pieces(offsets):
                x = features(stats(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, N_FEATURES)


def summed(known: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], add: Callable = np.add) -> np.ndarray | None:
    """The sum of f(x, y) over all rows of (x, y); those of tasks are added in the tasks' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = f(matrix(batch.column(0)), batch.column(1).to_numpy())
                total = own if total is None else add(total, own)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["task", "total"])

    parts = sorted((r.task, r.total) for r in known.mapInArrow(run, "task long, total array<double>").collect())
    total = None
    for _, part in parts:
        total = np.array(part) if total is None else add(total, np.array(part))
    return total


def on_grid(raw: np.ndarray, lo: float, hi: float, points: int) -> tuple[np.ndarray, np.ndarray]:
    """The grid point below each score, and how far on the way to the next it is."""
    at = np.clip((raw - lo) / (hi - lo) * (points - 1), 0, points - 1)
    below = np.minimum(at.astype(int), points - 2)
    return below, at - below


def bradley_terry(known: DataFrame, mean: np.ndarray, scale: np.ndarray, least: np.ndarray, most: np.ndarray, p: Ranking) -> np.ndarray:
    """Weights that minimise the mean logistic loss of better - worse over all pairs, by Newton steps; features lie between least and most."""
    k, m = N_FEATURES, p.grid
    w = np.zeros(k)
    for _ in range(p.steps):
        lo, hi = score_range(w, least, most)

        def sums(x: np.ndarray, y: np.ndarray, w=w, lo=lo, hi=hi) -> np.ndarray:
            z = (x - mean) / scale
            below, part = on_grid(z @ w, lo, hi, m)
            cell, z = below + m * y, np.column_stack([np.ones(len(z)), z])
            count = lambda at, v: np.bincount(at, weights=v, minlength=2 * m)
            return np.column_stack([count(cell, (1 - part) * v) + count(cell + 1, part * v) for v in z.T])

        got = summed(known, sums).reshape(2, m, k + 1)
        (n0, n1), (x0, x1) = got[:, :, 0], got[:, :, 1:]
        point = np.linspace(lo, hi, m)
        chance = 1 / (1 + np.exp(-np.clip(point[:, None] - point[None, :], -30, 30)))  # of a row here before one there
        doubt = chance * (1 - chance)
        pairs = n0.sum() * n1.sum()
        weight = np.stack([n1 @ doubt, doubt @ n0]) / pairs

        def squares(x: np.ndarray, y: np.ndarray, w=w, lo=lo, hi=hi, weight=weight) -> np.ndarray:
            z = (x - mean) / scale
            below, part = on_grid(z @ w, lo, hi, m)
            return (z.T * ((1 - part) * weight[y, below] + part * weight[y, below + 1])) @ z

        cross = x1.T @ doubt @ x0 / pairs
        gradient = (x1.T @ ((chance - 1) @ n0) - x0.T @ (n1 @ (chance - 1))) / pairs + p.ridge * w
        step = np.linalg.solve(summed(known, squares).reshape(k, k) - cross - cross.T + p.ridge * np.eye(k), gradient)
        w = w - step
        if np.abs(step).max() < 1e-5:
            break
    return w


def score_range(w: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[float, float]:
    """Bounds of all scores, a little apart."""
    return float(np.minimum(w * least, w * most).sum()) - 1e-3, float(np.maximum(w * least, w * most).sum()) + 1e-3


def ranked_score(known: DataFrame, raw: Callable, rank: int, lo: float, hi: float) -> float:
    """The score of that rank (from 0) among all rows, or just below it, by histograms of ever narrower ranges."""
    exact, cells = (hi - lo) * 1e-10, 4096
    while hi - lo > exact:

        def counts(x: np.ndarray, y: np.ndarray, lo=lo, hi=hi) -> np.ndarray:
            return np.bincount(np.searchsorted(np.linspace(lo, hi, cells + 1), raw(x), side="right"), minlength=cells + 2).astype(float)

        cell = int(np.searchsorted(np.cumsum(summed(known, counts)), rank, side="right"))
        edge = np.linspace(lo, hi, cells + 1)
        if not 0 < cell <= cells:
            break
        lo, hi = float(edge[cell - 1]), float(edge[cell])
    return lo


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float
    offset: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights - self.threshold
        return 1 / (1 + np.exp(-np.clip(raw + self.offset, -30, 30)))


def learnable(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of all labels that may be learnt from; nothing held out.

    A doc_id with several labels has the smallest; null ids and labels other than 0 and 1 teach nothing.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    return own.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))


def learnt_rows(labels: DataFrame, column: str, sample: int) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """At most ``sample`` (doc_id, label) of each label in hash order of doc_id, and all counts by label, of what is learnable."""
    own = learnable(labels, column)
    counts = {r.y: r.n for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rows = []
    for y in sorted(counts):
        rows += [(r.doc_id, y) for r in own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    return rows, counts


def fit(rows: DataFrame, labels: DataFrame, p: Ranking) -> Model | None:
    """From (doc_id, x) of all documents: every one with a label that may be learnt from counts."""
    known = materialise(rows.join(learnable(labels, "quality"), "doc_id").select("x", "y")).coalesce(p.tasks)
    got = summed(known, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0)]))
    if got is None or got[1] in (0, got[0]):
        return None
    n, n1, mean = int(got[0]), int(got[1]), got[2:] / got[0]
    scale = np.maximum(np.sqrt(summed(known, lambda x, y: ((x - mean) ** 2).sum(0)) / n), 1e-6)
    ends = summed(known, lambda x, y: np.stack([-x.min(0), x.max(0)]), np.maximum).reshape(2, -1)
    least, most = (-ends[0] - mean) / scale, (ends[1] - mean) / scale
    w = bradley_terry(known, mean, scale, least, most, p)
    threshold = ranked_score(known, lambda x: ((x - mean) / scale) @ w, n - n1, *score_range(w, least, most))
    return Model(mean, scale, w, threshold, float(np.log(p.at_threshold / (1 - p.at_threshold))))


def rank_quality(docs: DataFrame, labels: DataFrame, p: Ranking = Ranking()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Null texts count as empty and are scored like any other; a null doc_id is kept (held_out null). Without labels of
    both kinds to learn from, every score is 0.5. Repeated rows each give a row; rows that tie in all features tie in the
    score; an empty table gives none; columns other than doc_id, text (and quality of the labels) are ignored.
    """
    rows = materialise(feature_rows(docs))
    model = fit(rows, labels, p) or (lambda x: np.full(len(x), 0.5))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model(matrix(batch.column(1))), pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= p.at_threshold).cast("int").alias("predicted"))
