"""Packing token pieces into sequences: best fit, then swap-based local search, on the histogram of lengths.

There are at most ``limit`` distinct lengths, so a packing is a short list of patterns (the lengths in a sequence) with
multiplicities, whatever the number of documents. Best-fit decreasing gives a first packing. The local search then looks
at underfull bins only: it moves one piece, or exchanges one for one or two for one between two of them, whenever that
increases the sum of squared fills; the emptier bin thereby runs empty. Pieces take their places by their rank within
their length, which two-level counting gives without ever gathering a length in one task.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandweave.llm.common import materialise


@dataclass(frozen=True)
class Packing:
    """Tokens of a sequence; id that ends a document; vocabulary file; text of its special token; rows of a salt."""

    limit: int = 1024
    end_id: int = 2
    vocabulary: str = "byte_bpe_50k.tiktoken"
    special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)
    salt_rows: int = 4096


# --- tokens ---

_encoders: dict = {}


def encoder(vocabulary: str, special: tuple[tuple[str, int], ...]):
    """The public byte-level vocabulary by its rank file; the special token's text is one id, as in the JSON form of it."""
    if (vocabulary, special) not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[vocabulary, special] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))
    return _encoders[vocabulary, special]


def token_ids(text: str | None, p: Packing) -> np.ndarray:
    enc = encoder(p.vocabulary, p.special)
    ids = enc.encode_to_numpy(text or "", allowed_special="all") if hasattr(enc, "encode_to_numpy") else enc.encode(text or "", allowed_special="all")
    return np.append(np.asarray(ids, np.uint32), np.uint32(p.end_id)).astype("<u4")


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only what is longer than the limit is cut, and only the first piece may be shorter."""
    if n <= limit:
        return [(0, n)]
    head = n % limit
    starts = ([0] if head else []) + list(range(head, n, limit))
    return [(s, (starts[k + 1] if k + 1 < len(starts) else n) - s) for k, s in enumerate(starts)]


def pieces_of(docs: DataFrame, p: Packing) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = token_ids(text.as_py(), p)
                raw = memoryview(ids).cast("B")
                for j, (s, n) in enumerate(cut(len(ids), p.limit)):
                    row.append(k)
                    piece.append(j)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
            ints = (pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *ints], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- patterns ---

Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], limit: int) -> Counter:
    """Patterns with multiplicities: lengths in falling order, each into the fullest bins that still take it."""
    open_bins: dict[int, Counter] = defaultdict(Counter)  # free space -> patterns
    spaces: list[int] = []

    def put(pattern: Pattern, n: int) -> None:
        free = limit - sum(pattern)
        if free not in open_bins or not open_bins[free]:
            if free not in spaces:
                bisect.insort(spaces, free)
        open_bins[free][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at == len(spaces):  # no bin has room: new ones
                fill = limit // length
                whole, rest = divmod(left, fill)
                if whole:
                    put((length,) * fill, whole)
                if rest:
                    put((length,) * rest, 1)
                break
            space = spaces[at]
            pattern, n = next(iter(open_bins[space].items()))
            fit = space // length
            bins = min(n, left // fit)
            add = fit
            if not bins:
                bins, add = 1, left
            open_bins[space][pattern] -= bins
            if not open_bins[space][pattern]:
                del open_bins[space][pattern]
            if not open_bins[space]:
                del open_bins[space]
                spaces.pop(at)
            put(tuple(sorted(pattern + (length,) * add, reverse=True)), bins)
            left -= bins * add
    out: Counter = Counter()
    for group in open_bins.values():
        out.update(group)
    return out


def _swapped(a: Pattern, b: Pattern, give: Pattern, take: Pattern) -> tuple[Pattern, Pattern]:
    """Both patterns after ``a`` gave ``give`` to ``b`` and took ``take`` from it."""
    left, right = Counter(a), Counter(b)
    left.subtract(give)
    right.subtract(take)
    left.update(take)
    right.update(give)
    return tuple(sorted(left.elements(), reverse=True)), tuple(sorted(right.elements(), reverse=True))


def _better(a: Pattern, b: Pattern, limit: int) -> tuple[Pattern, Pattern] | None:
    """The best of all moves and exchanges that make ``a`` (the fuller) fuller still; None if none does."""
    room, best = limit - sum(a), (0, (), ())
    ones_a, ones_b = [((), 0), *(((y,), y) for y in set(a))], [((x,), x) for x in set(b)]
    twos_a, twos_b = ([(c, sum(c)) for c in set(combinations(p, 2))] for p in (a, b))
    for gives, takes in ((ones_a, ones_b), (ones_a[1:], twos_b), (twos_a, ones_b)):
        for give, out in gives:
            for take, into in takes:
                gain = into - out
                if 0 < gain <= room and (gain, give, take) > best:
                    best = (gain, give, take)
    return _swapped(a, b, best[1], best[2]) if best[0] else None


class Underfull:
    """Underfull bins by pattern, with the patterns that hold each length and each sum of two lengths."""

    def __init__(self, bins: Counter, limit: int):
        self.limit, self.count = limit, Counter()
        self.ones: dict[int, set[Pattern]] = defaultdict(set)
        self.twos: dict[int, set[Pattern]] = defaultdict(set)
        self.done: Counter = Counter()
        for pattern, n in bins.items():
            self.add(pattern, n)

    def add(self, pattern: Pattern, n: int) -> None:
        if not pattern or not n:
            return
        if sum(pattern) == self.limit:
            self.done[pattern] += n
            return
        if not self.count[pattern]:
            for x in set(pattern):
                self.ones[x].add(pattern)
            for c in set(combinations(pattern, 2)):
                self.twos[sum(c)].add(pattern)
        self.count[pattern] += n

    def take(self, pattern: Pattern, n: int) -> None:
        self.count[pattern] -= n
        if not self.count[pattern]:
            del self.count[pattern]
            for x in set(pattern):
                self.ones[x].discard(pattern)
            for c in set(combinations(pattern, 2)):
                self.twos[sum(c)].discard(pattern)

    def change(self, a: Pattern, b: Pattern, after: tuple[Pattern, Pattern]) -> None:
        """As many bins as both patterns have change at once."""
        n = self.count[a] // 2 if a == b else min(self.count[a], self.count[b])
        self.take(a, n)
        self.take(b, n)
        for pattern in after:
            self.add(pattern, n)

    def filled(self, a: Pattern) -> tuple[Pattern, tuple[Pattern, Pattern]] | None:
        """(b, both afterwards) of the emptiest underfull bin that can fill ``a`` to the brim: by a move, two for one, one
        for one, or one for two. Whatever bin gives, the sum of squared fills increases."""
        room = self.limit - sum(a)
        if room in self.ones and (b := self._emptiest(self.ones[room], a)):
            return b, _swapped(a, b, (), (room,))
        for y in sorted(set(a), reverse=True):
            if b := self._emptiest(self.twos.get(y + room, ()), a):
                pair = next(c for c in combinations(b, 2) if sum(c) == y + room)
                return b, _swapped(a, b, (y,), pair)
        for y in sorted(set(a)):
            if b := self._emptiest(self.ones.get(y + room, ()), a):
                return b, _swapped(a, b, (y,), (y + room,))
        for pair in sorted(set(combinations(a, 2))):
            if b := self._emptiest(self.ones.get(sum(pair) + room, ()), a):
                return b, _swapped(a, b, pair, (sum(pair) + room,))
        return None

    def given(self, b: Pattern) -> tuple[Pattern, tuple[Pattern, Pattern]] | None:
        """(a, both afterwards) of the exchange by which ``b`` raises the sum of squared fills most, to a bin that is as full at least."""
        best, out = 0, None
        for a in sorted(self.count, key=lambda p: (sum(p), p)):  # most room first
            room = self.limit - sum(a)
            if sum(a) < sum(b) or (a == b and self.count[b] < 2):
                continue
            if 2 * room * (self.limit - sum(b)) <= best:
                break
            if after := _better(a, b, self.limit):
                gain = sum(after[0]) - sum(a)
                if 2 * gain * (sum(a) - sum(b) + gain) > best:
                    best, out = 2 * gain * (sum(a) - sum(b) + gain), (a, after)
        return out

    def _emptiest(self, patterns, but: Pattern) -> Pattern | None:
        some = [p for p in patterns if p != but or self.count[p] > 1]
        return min(some, key=lambda p: (sum(p), p)) if some else None


def local_search(bins: Counter, limit: int) -> Counter:
    """Exchanges between underfull bins until none improves: each raises the sum of squared fills, so the search ends.

    First every bin that some other can fill to the brim is, the fullest first. When no bin can be filled so, the emptiest one
    gives to the bin whose exchange raises the squared fills most, until it is empty or can give nothing more; then bins are
    filled again.
    """
    pool = Underfull(bins, limit)
    stuck: set[Pattern] = set()
    todo = [(-sum(p), p) for p in pool.count]
    whole = True  # todo holds all bins, not only those that changed last
    heapq.heapify(todo)
    while True:
        while todo:
            _, a = heapq.heappop(todo)
            while pool.count[a] and (found := pool.filled(a)):
                b, after = found
                pool.change(a, b, after)
                for p in (*after, b):
                    if pool.count[p] and p != a:
                        heapq.heappush(todo, (-sum(p), p))
        if sum((limit - sum(p)) * n for p, n in pool.count.items()) < limit:  # less room than one bin: none can run empty
            break
        change = next(((g, *x) for g in sorted(pool.count.keys() - stuck, key=lambda p: (sum(p), p)) if (x := pool.given(g)) or stuck.add(g)), None)
        if change:
            giver, taker, after = change
            pool.change(taker, giver, after)
            stuck -= set(after)
            todo, whole = [(-sum(p), p) for p in after if pool.count[p]], False
        elif whole:
            break
        else:
            todo, whole = [(-sum(p), p) for p in pool.count], True
            stuck.clear()
        heapq.heapify(todo)
    return +(pool.done + pool.count)


def places(bins: Counter) -> dict[str, np.ndarray]:
    """For the k-th piece of each length: arrays of runs (length, first rank, first sequence, offset), sorted for lookup."""
    rows, base, rank = [], 0, Counter()
    for pattern, n in sorted(bins.items(), reverse=True):
        offset = 0
        for length in pattern:
            rows.append((length, rank[length], base, offset))
            rank[length] += n
            offset += length
        base += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack_lengths(counts: dict[int, int], p: Packing) -> Counter:
    return local_search(best_fit(counts, p.limit), p.limit)


def pack(docs: DataFrame, p: Packing = Packing()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row of ``docs`` in its place.

    A null or empty text is the end id alone. Rows that repeat a doc_id are documents of their own; a null doc_id is
    kept. Ties (pieces of one length) take places in hash order of doc_id and piece. An empty table gives no row; other
    columns are ignored, whatever their names. What the driver holds are counts by length and the patterns, at most a few
    for each length.
    """
    spark = docs.sparkSession
    own = materialise(pieces_of(docs, p))
    full = own.count()
    salts = max(1, math.ceil(full / p.salt_rows))
    salt = F.pmod(F.xxhash64("doc_id", "piece", F.lit(5)), F.lit(salts)).cast("int")
    keyed = own.withColumn("salt", salt)
    counted = keyed.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select(F.col("length").alias("l"), F.col("salt").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    run = places(pack_lengths(counts, p))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("row", F.row_number().over(within) - 1).join(base, (F.col("length") == F.col("l")) & (F.col("salt") == F.col("s")))
    most = full + 1

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(run["length"] * most + run["rank"], length.to_numpy() * most + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": run["sequence"][at] + rank.to_numpy() - run["rank"][at], "offset": run["offset"][at]})

    out = ranked.withColumn("place", place(F.col("length"), F.col("base") + F.col("row")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
