"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, distance-weighted votes.

Terms are lower-case words, and on request the first bytes of long words, by hash; the vocabulary is every term of every learnt example.
A term weighs (1 + log count) * idf * tell: idf counts over all documents, tell says how far the term's shares in toxic
and in clean examples are apart (never 0, so a copy of an example always finds it). Examples are ordered by their heaviest
term and cut into blocks. The index lists, for each term, the blocks that hold it with its largest weight there, and
behind each of these its postings. A query sums the largest weights to a bound for every block, scores the most
promising blocks, and then all others whose bound reaches the k-th cosine so far: the neighbours are exactly those of an
exhaustive search. Votes become probabilities by isotonic calibration on leave-one-out votes of the examples themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import held_out
from strandweave.llm.pairwise_rank import learnt_rows
from strandweave.llm.textkernel import FOLD, TERM, U, hashes, mix, pieces, prefix, spans, text_buffer


@dataclass(frozen=True)
class Neighbours:
    """Most examples of each label that are learnt from; k; examples of a block; blocks that are scored before others are
    left out; bytes of word beginnings that are terms; weight of a term that tells nothing, and examples with a term from which
    on its shares count in full; weight of the prior vote; parts of the vocabulary that are counted apart."""

    sample: int = 1500
    k: int = 15
    block: int = 64
    ahead: int = 4
    heads: tuple[int, ...] = ()
    floor: float = 0.05
    full: int = 5
    prior: float = 0.3
    parts: int = 64


def term_hashes(data: np.ndarray, offsets: np.ndarray, p: Neighbours) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) of all words and word beginnings."""
    folded = FOLD[data]
    start, end, doc = spans(TERM[data], offsets)
    sums = prefix(folded)
    docs, terms = [doc], [hashes(sums, start, end)]
    for n in p.heads:
        long = end - start > n
        docs.append(doc[long])
        terms.append(mix(hashes(sums, start[long], start[long] + n) + U(n)))
    return np.concatenate(docs), np.concatenate(terms)


def counted_terms(data: np.ndarray, offsets: np.ndarray, p: Neighbours, vocabulary: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term or its place in the sorted vocabulary, count), sorted by text."""
    doc, term = term_hashes(data, offsets, p)
    if vocabulary is not None:
        at = np.minimum(np.searchsorted(vocabulary, term), max(0, len(vocabulary) - 1))
        known = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
        doc, term = doc[known], at[known].astype(U)
    if not len(doc):
        return doc, term, doc
    by = np.lexsort((term, doc))
    doc, term = doc[by], term[by]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])]))
    return doc[new], term[new], np.diff(np.append(new, len(doc)))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        for lo, hi in pieces(offsets):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def example_terms(texts: DataFrame, p: Neighbours) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(terms, counts) of each learnt (doc_id, text): rows of a bounded sample, gathered as Arrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            doc, term, count = counted_terms(data, offsets, p, None)
            at = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = (pa.ListArray.from_arrays(pa.array(at), pa.array(x.astype(np.int64) if x.dtype != U else x.view(np.int64))) for x in (term, count))
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["doc_id", "terms", "counts"])

    got = texts.mapInArrow(run, "doc_id long, terms array<long>, counts array<long>").toArrow()
    ids, terms, counts = got.column(0).to_pylist(), got.column(1), got.column(2)
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for k, doc_id in enumerate(ids):
        own = terms[k].values.to_numpy().view(U), counts[k].values.to_numpy()
        if doc_id not in out or (own[0].tolist(), own[1].tolist()) < (out[doc_id][0].tolist(), out[doc_id][1].tolist()):
            out[doc_id] = own  # of several texts with one id the first, in order of terms
    return out


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, p: Neighbours) -> tuple[np.ndarray, int]:
    """For each term the number of all documents with it, and the number of documents.

    Every task counts the whole vocabulary, one array for each part of it; arrays are added in two steps, so what a task of the second
    step holds does not grow with the number of the first one's.
    """
    borders = np.linspace(0, len(vocabulary), p.parts + 1).astype(int)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(shared.value), np.int64), 0
        for part, data, offsets in chunks(batches):
            _, term, _ = counted_terms(data, offsets, p, shared.value)
            df += np.bincount(term.astype(np.int64), minlength=len(df))
            n += part.num_rows
        own = [df[lo:hi] for lo, hi in zip(borders[:-1], borders[1:], strict=True)] + [np.array([n])]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(list(own), pa.list_(pa.int64()))], names=["part", "df"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.sum([x.values.to_numpy() for x in table.column("df")], axis=0, dtype=np.int64)
        return pa.table({"part": pa.array([table.column("part")[0].as_py()]), "df": pa.array([total], pa.list_(pa.int64()))})

    counted = docs.mapInArrow(count, "part long, df array<long>").withColumn("salt", F.spark_partition_id() % 256)
    some = counted.groupBy("part", "salt").applyInArrow(add, "part long, df array<long>")
    rows = {r.part: r.df for r in some.groupBy("part").applyInArrow(add, "part long, df array<long>").collect()}
    if not rows:
        return np.zeros(len(vocabulary), np.int64), 0
    return np.concatenate([np.array(rows[k], np.int64) for k in range(p.parts)]), rows[p.parts][0]


def tells(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, p: Neighbours) -> np.ndarray:
    """How much a term tells: the logarithm of the ratio of its shares, less where few examples have it."""
    ratio = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return p.floor + np.abs(ratio) * np.minimum(1, (toxic + clean) / p.full)


def vectors(doc: np.ndarray, term: np.ndarray, count: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Weights of (text, term) entries: (1 + log count) * the term's weight, of length 1 for each text."""
    w = (1 + np.log(count)) * weight[term.astype(np.int64)]
    norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=n))
    return w / norm[doc]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each of the ranges, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum()))


@dataclass
class Index:
    """Postings by term, block and example. ``of_term[t]`` to ``of_term[t + 1]`` are the term's entries (block, largest weight
    in it, first posting); the postings (example, weight) of an entry end where the next entry's begin."""

    ids: np.ndarray
    toxic: np.ndarray
    block: int
    ahead: int
    of_term: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    first: np.ndarray
    example: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, toxic: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], n_terms: int, p: Neighbours) -> "Index":
        heaviest = np.array([t[np.argmax(w)] for t, w in rows]) if rows else np.zeros(0, int)
        by = np.lexsort((ids, heaviest))
        rows = [rows[k] for k in by]
        term = np.concatenate([t for t, _ in rows]) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([w for _, w in rows]) if rows else np.zeros(0)
        example = np.repeat(np.arange(len(rows)), [len(t) for t, _ in rows])
        order = np.lexsort((example, term))
        term, weight, example = term[order], weight[order], example[order]
        block = example // p.block
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, int)
        maxima = np.maximum.reduceat(weight, new) if len(new) else np.zeros(0)
        of_term = np.searchsorted(term[new], np.arange(n_terms + 1))
        return cls(ids[by], toxic[by], p.block, p.ahead, of_term, block[new].astype(np.int32), maxima, np.append(new, len(term)), example, weight)

    def scored(self, entry: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines over 0) of all postings of the entries, summed in order of terms."""
        length = self.first[entry + 1] - self.first[entry]
        at = ranges(self.first[entry], length)
        score = np.bincount(self.example[at], weights=np.repeat(weight, length) * self.weight[at], minlength=len(self.ids))
        found = np.flatnonzero(score > 0)
        return found, score[found]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(example numbers, cosines) of the k nearest with a cosine over 0, nearest first, ties to the smaller id."""
        n = self.of_term[terms + 1] - self.of_term[terms]
        entry = ranges(self.of_term[terms], n)
        weight, block = np.repeat(weights, n), self.blocks[entry]
        bound = np.bincount(block, weights=weight * self.maxima[entry], minlength=-(-len(self.ids) // self.block))
        todo = bound > 0
        at, cos = np.zeros(0, np.int64), np.zeros(0)
        while todo.any():
            if len(at) < k:
                some = np.flatnonzero(todo)
                wanted = np.zeros(len(todo), bool)
                wanted[some[np.argsort(-bound[some], kind="stable")[: self.ahead * (1 if not len(at) else 16)]]] = True
            else:
                todo &= bound >= cos[-1] * (1 - 1e-9)
                wanted = todo.copy()
            mine = wanted[block]
            new, score = self.scored(entry[mine], weight[mine])
            todo &= ~wanted
            if but is not None:
                other = self.ids[new] != but
                new, score = new[other], score[other]
            if len(at) == k:
                near = score >= cos[-1]
                new, score = new[near], score[near]
            at, cos = np.concatenate([at, new]), np.concatenate([cos, score])
            by = np.lexsort((self.ids[at], -cos))[:k]
            at, cos = at[by], cos[by]
        return at, cos


@dataclass
class Model:
    vocabulary: np.ndarray
    weight: np.ndarray  #: of each term
    index: Index
    base: float  #: share of toxic rows among all that may be learnt from
    p: Neighbours
    none: float = 0.0  #: score of a text without any term of the vocabulary
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))

    def vote(self, terms: np.ndarray, weights: np.ndarray, but: int | None) -> tuple[float, np.ndarray, np.ndarray]:
        at, cos = self.index.nearest(terms, weights, self.p.k, but)
        return (float(cos @ self.index.toxic[at]) + self.p.prior * self.base) / (float(cos.sum()) + self.p.prior), at, cos

    def calibrated(self, vote: float) -> float:
        return float(np.interp(vote, *self.steps))


def isotonic(vote: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Increasing steps from votes to rates, by pooling adjacent violators; (vote, rate) knots, smoothed by half a row."""
    by = np.argsort(vote, kind="stable")
    blocks: list[list[float]] = []  # sum of votes * weight, toxic weight, weight
    for v, t, w in zip(vote[by], y[by], weight[by], strict=True):
        blocks.append([v * w, t * w, w])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], (b[:, 1] + 0.25) / (b[:, 2] + 0.5)


def fit(docs: DataFrame, labels: DataFrame, p: Neighbours) -> Model | None:
    """``docs`` has doc_id and text. The driver gets the terms of the sample, at most 2 * p.sample rows."""
    spark = docs.sparkSession
    rows, counts = learnt_rows(labels, "toxic", p.sample)
    label = dict(rows)
    if len(set(label.values())) < 2:
        return None
    asked = F.broadcast(spark.createDataFrame(rows, "y_id long, y int"))
    got = example_terms(docs.join(asked, F.col("doc_id") == F.col("y_id")).select("doc_id", "text"), p)
    vocabulary = np.unique(np.concatenate([t for t, _ in got.values()] or [np.zeros(0, U)]))
    df, n = document_frequencies(docs, vocabulary, p)
    known = sorted(got)
    doc = np.repeat(np.arange(len(known)), [len(got[k][0]) for k in known])
    term = np.concatenate([np.searchsorted(vocabulary, got[k][0]) for k in known] or [np.zeros(0, np.int64)])
    count = np.concatenate([got[k][1] for k in known] or [np.zeros(0, np.int64)])
    y = np.array([label[k] for k in known], float)
    toxic = np.bincount(term, weights=y[doc], minlength=len(vocabulary))
    every = np.bincount(term, minlength=len(vocabulary))
    weight = (np.log((1 + n) / (1 + df)) + 1) * tells(toxic, every - toxic, int(y.sum()), int(len(y) - y.sum()), p)
    w = vectors(doc, term, count, weight, len(known))
    at = np.searchsorted(doc, np.arange(len(known) + 1))
    some = np.flatnonzero(np.diff(at))
    vector = {int(k): (term[at[k] : at[k + 1]], w[at[k] : at[k + 1]]) for k in some}
    ids = np.array(known, np.int64)
    index = Index.build(ids[some], y[some], list(vector.values()), len(vocabulary), p)
    each = {v: counts[v] / max(1, int((y == v).sum())) for v in (0, 1)}  # documents that an example stands for
    m = Model(vocabulary, weight, index, counts[1] / (counts[0] + counts[1]), p)
    empty = np.setdiff1d(np.arange(len(known)), some)
    m.none = (each[1] * y[empty].sum() + m.base) / (each[1] * y[empty].sum() + each[0] * (1 - y[empty]).sum() + 1)
    if len(some):
        votes = np.array([m.vote(*vector[int(k)], known[k])[0] for k in some])
        m.steps = isotonic(votes, y[some], np.where(y[some] > 0, each[1], each[0]))
    return m


def rated(m: Model | None, ids: list, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
    """(score, evidence) of each text; ``ids`` are their doc_ids."""
    n = len(ids)
    score, evidence = np.zeros(n), [[] for _ in range(n)]
    if m is not None:
        score[:] = m.none
        doc, term, count = counted_terms(data, offsets, m.p, m.vocabulary)
        w = vectors(doc, term, count, m.weight, n)
        at = np.searchsorted(doc, np.arange(n + 1))
        for k in np.unique(doc):
            vote, near, cos = m.vote(term[at[k] : at[k + 1]].astype(np.int64), w[at[k] : at[k + 1]], ids[k])
            if len(near):
                score[k] = m.calibrated(vote)
                evidence[k] = [{"doc_id": int(m.index.ids[i]), "cosine": float(c), "toxic": int(m.index.toxic[i])} for i, c in zip(near[:3], cos[:3], strict=True)]
    return score, evidence


def rate_toxicity(docs: DataFrame, labels: DataFrame, p: Neighbours = Neighbours()) -> DataFrame:
    """(doc_id, held_out, score, predicted, neighbours) of every row of ``docs``.

    neighbours is the evidence: the nearest examples (doc_id, cosine, toxic), at most 3, nearest first; a row's own
    doc_id is never among its examples. Null and empty texts, and texts without a term of any example, have the rate
    of such examples and no evidence; all others have neighbours. A null doc_id is kept (held_out null); repeated rows each give a row; without labels
    of both kinds to learn from every score is 0; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(own, labels, p)
    shared = spark.sparkContext.broadcast(model)  # bounded: 2 * p.sample sparse rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for part, data, offsets in chunks(batches):
            score, evidence = rated(m, part.column(0).to_pylist(), data, offsets)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(evidence, kind)], names=["doc_id", "score", "neighbours"])

    out = own.mapInArrow(run, "doc_id long, score double, neighbours array<struct<doc_id long, cosine double, toxic int>>")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours")


def drop_toxic(docs: DataFrame, labels: DataFrame, p: Neighbours = Neighbours()) -> DataFrame:
    """The rows of ``docs`` that are not rated toxic, with all their columns.

    Each row goes or stays by its own text, in the pass that rates it; rows without a doc_id, or with one that comes more
    than once, are rated like others. Null and empty texts are rated as empty, long ones as a whole; an empty table gives
    none; without labels of both kinds all rows stay; columns of any other name pass as they are.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(own, labels, p))  # bounded as in rate_toxicity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in chunks(batches):
            score, _ = rated(shared.value, part.column(0).to_pylist(), data, offsets)
            row = part.select(list(range(2, part.num_columns)))
            yield row.filter(pa.array(score < 0.5))

    named = [F.col("doc_id").cast("long").alias("rated_id_"), F.col("text").alias("rated_text_")]
    return docs.select(*named, *docs.columns).mapInArrow(run, docs.schema)
