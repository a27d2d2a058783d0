"""Stupid-backoff scores of documents under n-gram counts of the corpus.

score(w | context) = count(context w) / count(context) where the n-gram comes at least ``least`` times, else ``alpha`` times
the score with a context shorter by one word; a single word has count(w) / words of the corpus.

The relations: texts are packed into chunks of a few MB; a chunk's distinct n-grams, with their counts, go to hash
partitions of the count tables (sorted, delta-coded: some five bytes each); a partition adds the counts up and joins them
back to the n-grams that asked, in the order in which they came; chunks then look up each n-gram of each document and sum
per document. What is gathered from the corpus so is every n-gram of it, pre-aggregated within chunks: a frequent n-gram
costs a partition one entry for each chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import materialise
from strandweave.llm.textkernel import U, pieces, text_buffer, windows, words


@dataclass(frozen=True)
class Backoff:
    """Longest n-gram; factor of a step back; least count of an n-gram of two or more words that is used; bits of a
    hash (more for more distinct n-grams: a corpus of T has about T*T / 2**(bits+1) clashes); bytes of a chunk; n-grams
    and least number of partitions of the count tables."""

    order: int = 2
    alpha: float = 0.4
    least: int = 2
    bits: int = 52
    chunk_bytes: int = 4 << 20
    partition_rows: int = 400_000
    partitions: int = 128


# --- packed arrays ---


def planes(x: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, without the upper ones that are zero."""
    if not len(x):
        return b"\0"
    n = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([n]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    n = raw[0]
    if not n:
        return np.zeros(0, U)
    part = np.frombuffer(raw, np.uint8, offset=1).reshape(n, -1)
    out = np.zeros((part.shape[1], 8), np.uint8)
    out[:, :n] = part.T
    return out.view("<u8").ravel()


def pack_sorted(h: np.ndarray) -> bytes:
    return planes(np.diff(h, prepend=U(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw), dtype=U)


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all words; arrays by byte are made for a part of the texts at a time."""
    doc, word = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for lo, hi in pieces(offsets):
        _, _, d, h = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        doc.append(d + lo)
        word.append(h)
    return np.concatenate(doc), np.concatenate(word)


def chunked(docs: DataFrame, p: Backoff) -> DataFrame:
    """(chunk, ids, ends, texts, n_words): runs of documents, their texts end to end and compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        sizes: list[int] = []
        parts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal made, ids, sizes, parts
            raw = b"".join(parts)
            ends = np.cumsum(sizes)
            doc, _ = hashed_words(np.frombuffer(raw, np.uint8), np.append(0, ends))
            row = [[(task << 32) + made], [ids], [ends.tolist()], [zstandard.compress(raw, 1)], [len(doc)]]
            made, ids, sizes, parts = made + 1, [], [], []
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names=["chunk", "ids", "ends", "texts", "n_words"])

        held = 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                size = int(offsets[k + 1] - offsets[k])
                if ids and held + size > p.chunk_bytes:
                    yield flush()
                    held = 0
                ids.append(doc_id)
                sizes.append(size)
                parts.append(data[offsets[k] : offsets[k + 1]].tobytes())
                held += size
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "chunk long, ids array<long>, ends array<long>, texts binary, n_words long")


def grams(texts: bytes, ends: np.ndarray, p: Backoff) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(text number of each word, for each order (hash, number of the first word) of all n-grams)."""
    data = np.frombuffer(zstandard.decompress(texts), np.uint8) if texts else np.zeros(0, np.uint8)
    doc, word = hashed_words(data, np.append(0, np.asarray(ends, np.int64)))
    cut = U(64 - p.bits)
    out = [(word >> cut, np.arange(len(word)))]
    for n in range(2, p.order + 1):
        h, at = windows(word, doc, n)
        out.append((h >> cut, at))
    return doc, out


def partition_of(h: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Equal ranges of the hash, so that sorted hashes are in order of partitions."""
    return ((h >> U(bits - 32)) * U(n) >> U(32)).astype(np.int64)


def asked(chunks: DataFrame, n: int, p: Backoff) -> DataFrame:
    """(part, chunk, hashes, counts): each chunk's distinct n-grams by partition; part numbers orders and partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ends, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                _, own = grams(texts.as_py(), ends, p)
                for order, (h, _) in enumerate(own):
                    u, count = np.unique(h, return_counts=True)
                    at = np.searchsorted(partition_of(u, n, p.bits), np.arange(n + 1))
                    some = np.flatnonzero(np.diff(at))
                    cols = [pa.array(order * n + some, pa.int32()), pa.array(np.full(len(some), chunk))]
                    cols += [pa.array([f(x[at[k] : at[k + 1]]) for k in some], pa.binary()) for f, x in ((pack_sorted, u), (planes, count))]
                    yield pa.RecordBatch.from_arrays(cols, names=["part", "chunk", "hashes", "counts"])

    return chunks.select("chunk", "ends", "texts").mapInArrow(run, "part int, chunk long, hashes binary, counts binary")


def answered(questions: DataFrame) -> DataFrame:
    """(chunk, part, totals): for each question the counts in the whole corpus, in its own order of n-grams."""

    def run(table: pa.Table) -> pa.Table:
        h = [unpack_sorted(x) for x in table.column("hashes").to_pylist()]
        sizes = np.cumsum([len(x) for x in h])
        count = np.concatenate([unplanes(x) for x in table.column("counts").to_pylist()]).astype(np.int64)
        _, inverse = np.unique(np.concatenate(h), return_inverse=True)
        total = np.bincount(inverse, weights=count).astype(np.int64)[inverse]
        return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "totals": pa.array([planes(x) for x in np.split(total, sizes[:-1])], pa.binary())})

    return questions.groupBy("part").applyInArrow(run, "chunk long, part int, totals binary")


def score_chunk(ids: list, ends: list[int], texts: bytes, totals: list[list[bytes]], words_in_all: int, p: Backoff) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, sum of log scores, words scored with a shorter context than ``order`` allows) of each document of a chunk."""
    doc, own = grams(texts, ends, p)
    n = len(ids)
    count = []  # of the n-gram of each order that begins at each word; 0 if the text ends before
    for (h, at), parts in zip(own, totals, strict=True):
        total = np.concatenate([unplanes(x) for x in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
        u, inverse = np.unique(h, return_inverse=True)
        if len(u) != len(total):
            raise ValueError("answers do not fit the chunk")
        c = np.zeros(len(doc), np.int64)
        c[at] = total[inverse]
        count.append(c)
    log = np.log(np.maximum(count[0], 1)) - math.log(max(1, words_in_all))
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)  # of each word in its text
    used = np.ones(len(doc), np.int64)
    for order in range(2, p.order + 1):
        first = np.arange(len(doc)) - order + 1
        can = place >= order - 1
        c, context = np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64)
        c[can], context[can] = count[order - 1][first[can]], count[order - 2][first[can]]
        hit = can & (c >= p.least)
        log = np.where(hit, np.log(np.maximum(c, 1)) - np.log(np.maximum(context, 1)), np.where(can, math.log(p.alpha) + log, log))
        used[hit] = order
    short = used < np.minimum(place + 1, p.order)
    return np.bincount(doc, minlength=n), np.bincount(doc, weights=log, minlength=n), np.bincount(doc[short], minlength=n)


def score_documents(docs: DataFrame, p: Backoff = Backoff()) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score, n_backed_off) of every row of ``docs``, under the counts of all rows.

    log_score sums natural logarithms over the words, the first ones of a text with the context that there is. A text
    without words (null, empty or blank) has log_score 0 and no mean. A null doc_id is kept, rows that repeat count and
    are scored as often as they come; an empty table gives no row; other columns are ignored, whatever their names.
    """
    chunks = materialise(chunked(docs, p))
    total = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n = max(p.partitions, math.ceil(total / p.partition_rows))
    replies = answered(asked(chunks, n, p))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        part = right.column("part").to_numpy()
        raw = right.column("totals")
        totals = [[raw[int(k)].as_py() for k in np.flatnonzero(part // n == order)[np.argsort(part[part // n == order])]] for order in range(p.order)]
        out = []
        for k in range(left.num_rows):
            ids = left.column("ids")[k].as_py()
            w, s, b = score_chunk(ids, left.column("ends")[k].as_py(), left.column("texts")[k].as_py(), totals, total, p)
            out.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": w, "log_score": s, "n_backed_off": b}))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64()), "n_backed_off": pa.array([], pa.int64())})

    schema = "doc_id long, n_words long, log_score double, n_backed_off long"
    scored = chunks.select("chunk", "ids", "ends", "texts").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select("doc_id", "n_words", "log_score", mean.alias("mean_log_score"), "n_backed_off")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, u.i, u.w FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents) d,
    LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) u
), c1 AS (SELECT w, count(*) AS n FROM w GROUP BY 1),
pairs AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w),
c2 AS (SELECT before, w, count(*) AS n FROM pairs WHERE before IS NOT NULL GROUP BY 1, 2),
s AS (
  SELECT p.doc_id, CASE WHEN p.before IS NULL THEN ln(c1.n) - ln(t.n) WHEN c2.n >= 2 THEN ln(c2.n) - ln(b.n) ELSE ln(0.4) + ln(c1.n) - ln(t.n) END AS l,
    p.before IS NOT NULL AND c2.n < 2 AS backed
  FROM pairs p JOIN c1 ON p.w = c1.w LEFT JOIN c2 ON p.before = c2.before AND p.w = c2.w LEFT JOIN c1 b ON p.before = b.w, (SELECT count(*) AS n FROM w) t
), g AS (SELECT doc_id, count(*) AS n_words, sum(l) AS log_score, count(*) FILTER (WHERE backed) AS n_backed_off FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, round(coalesce(log_score, 0), 4) AS log_score,
  round(CASE WHEN n_words > 0 THEN log_score / n_words END, 4) AS mean_log_score, coalesce(n_backed_off, 0)::BIGINT AS n_backed_off
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""
