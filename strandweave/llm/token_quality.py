"""Quality rules on tokeniser fertility: tokens per word, characters per token, byte-fallback share and token entropy under
public vocabularies.

Each measure has a rejection band for each language (for rows without one, for the script of their letters) and each
octave of token counts, as short texts scatter more and have relatively more distinct tokens: a median plus or minus
``spread`` robust standard deviations of the documents that pass the base rules. A language and octave (cell) with few
such documents leans on a model in place of its own quartiles, the more the fewer they are: the octave's median over
languages plus what this language lies above others, and the octave's spread within languages. No count of documents
switches from one to the other.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.common import materialise
from strandweave.llm.swap_packing import encoder
from strandweave.llm.textkernel import pieces, text_buffer, words
from strandweave.llm.textstats import scripts, stats

MEASURES = ("chars_per_token", "chars_per_piece", "byte_share", "token_entropy", "tokens_per_word")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Bands:
    """Vocabularies; robust standard deviations a band reaches to each side; its least half-width by measure; documents that
    the model of a cell counts for; inverse error of a quartile's rank; most cells that are broadcast."""

    vocabulary: str = "byte_bpe_50k.tiktoken"
    pieces: str = "piece_bpe_32k.model"
    spread: float = 5.0
    floor: tuple[float, ...] = (0.2, 0.2, 0.03, 0.03, 0.3)
    prior: float = 50.0
    accuracy: int = 10_000
    broadcast_cells: int = 50_000


_models: dict = {}


def piece_model(name: str):
    if name not in _models:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        _models[name] = model, np.array([model.is_byte(k) for k in range(model.get_piece_size())])
    return _models[name]


def entropy(ids: np.ndarray) -> float:
    """Bits of a token drawn from the text, over the most that so many tokens could have; 1 for a single token."""
    if len(ids) < 2:
        return 1.0
    counts = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(counts * np.log2(counts)).sum() / np.log2(len(ids)))


def piece_counts(data: np.ndarray, offsets: np.ndarray, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, byte pieces) of the words of each text. A word's pieces do not depend on its neighbours, so each distinct word is encoded once."""
    model, is_byte = piece_model(name)
    start, end, doc, h = words(data, offsets)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    parts = model.encode([data[start[k] : end[k]].tobytes().decode() for k in first], num_threads=1) if len(first) else []
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.concatenate([[0], np.cumsum(size)])
    fallback = np.concatenate([[0], np.cumsum(is_byte[np.fromiter(chain.from_iterable(parts), np.int64, int(ends[-1]))])])
    n = len(offsets) - 1
    return tuple(np.bincount(doc, weights=x[which], minlength=n).astype(np.int64) for x in (size, fallback[ends[1:]] - fallback[ends[:-1]]))


def measured(docs: DataFrame, p: Bands) -> DataFrame:
    """(doc_id, band, the counts, n_tokens, n_pieces, the measures) of every row of ``docs``."""
    names = ["doc_id", "band", *COUNTS, "n_tokens", "n_pieces", *MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            langs = batch.column(2).to_pylist()
            for lo, hi in pieces(offsets):
                own, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                s = stats(own, off)
                ids = [np.asarray(encoder(p.vocabulary, ()).encode_to_numpy(own[off[k] : off[k + 1]].tobytes().decode())) for k in range(hi - lo)]
                tokens = np.array([len(x) for x in ids], np.int64)
                n_pieces, n_bytes = piece_counts(own, off, p.pieces)
                over = lambda a, b: a / np.maximum(b, 1)
                values = (over(s["chars"], tokens), over(s["word_chars"], n_pieces), over(n_bytes, n_pieces), np.array([entropy(x) for x in ids]), over(tokens, s["n_words"]))
                band = [x or y for x, y in zip(langs[lo:hi], scripts(own, off), strict=True)]
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(band), *(pa.array(s[c].astype(np.int64)) for c in COUNTS)]
                cols += [pa.array(tokens), pa.array(n_pieces), *(pa.array(v.astype(float)) for v in values)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    schema = "doc_id long, band string, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_tokens", "n_pieces")) + ", " + ", ".join(f"{c} double" for c in MEASURES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.alias("lang")).mapInArrow(run, schema)


def cells(good: DataFrame, p: Bands) -> DataFrame:
    """(band, octave, <measure>_low, <measure>_high) of every language and octave of the (band, octave, measures) rows."""
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], p.accuracy).alias(m) for m in MEASURES]
    own = good.groupBy("band", "octave").agg(F.count("*").alias("n"), *quartiles)
    by_octave, by_band, all_cells = Window.partitionBy("octave"), Window.partitionBy("band"), Window.partitionBy(F.lit(0))
    mean = lambda x, w, n=F.col("n"): F.sum(n * x).over(w) / F.sum(n).over(w)
    more = F.col("n") - 1  # a single document has no spread
    for m in MEASURES:
        own = own.withColumn(f"{m}_mid", F.col(m)[1]).withColumn(f"{m}_iqr", F.col(m)[2] - F.col(m)[0])
        own = own.withColumn(f"{m}_above", F.col(f"{m}_mid") - mean(F.col(f"{m}_mid"), by_octave))
        own = own.withColumn(f"{m}_above", mean(F.col(f"{m}_above"), by_band))
        own = own.withColumn(f"{m}_level", mean(F.col(f"{m}_mid") - F.col(f"{m}_above"), by_octave) + F.col(f"{m}_above"))
        overall = F.coalesce(F.try_divide(F.sum(more * F.col(f"{m}_iqr")).over(all_cells), F.sum(more).over(all_cells)), F.lit(0.0))
        own = own.withColumn(f"{m}_overall", overall)
        own = own.withColumn(f"{m}_width", (F.sum(more * F.col(f"{m}_iqr")).over(by_octave) + p.prior * F.col(f"{m}_overall")) / (F.sum(more).over(by_octave) + p.prior))
    n, out = F.col("n"), []
    for m, floor in zip(MEASURES, p.floor, strict=True):
        mid = (n * F.col(f"{m}_mid") + p.prior * F.col(f"{m}_level")) / (n + p.prior)
        iqr = (more * F.col(f"{m}_iqr") + p.prior * F.col(f"{m}_width")) / (more + p.prior)
        reach = F.greatest(p.spread * iqr / 1.349, F.lit(floor))
        out += [(mid - reach).alias(f"{m}_low"), (mid + reach).alias(f"{m}_high")]
    return own.select("band", "octave", *out)


def quality(docs: DataFrame, p: Bands = Bands()) -> DataFrame:
    """(doc_id, base counts, n_tokens, n_pieces, measures, base_failed, kept) of every row of ``docs``.

    base_failed: under 20 words, or more than 30 % of the words in 8-word windows that come twice. kept: not base_failed,
    and every measure within its band. A null text counts as empty, which fails; a null language uses its script; rows
    that repeat each give a row; an empty table gives none; other columns are ignored, whatever their names.
    """
    own = materialise(measured(docs, p).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))))
    own = own.withColumn("octave", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    bands = materialise(cells(own.where(~F.col("base_failed")), p)).withColumnsRenamed({"band": "b", "octave": "o"})
    if bands.count() <= p.broadcast_cells:  # some 100 bytes each; else Spark joins by key, and splits skewed ones as it runs
        bands = F.broadcast(bands)
    out = own.join(bands, (F.col("band") == F.col("b")) & (F.col("octave") == F.col("o")), "left")
    inside = functools.reduce(operator.and_, (F.col(m).between(F.col(f"{m}_low"), F.col(f"{m}_high")) for m in MEASURES))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return out.select("doc_id", *COUNTS, "n_tokens", "n_pieces", *MEASURES, *(f"{m}_{side}" for m in MEASURES for side in ("low", "high")), "base_failed", kept.alias("kept"))
