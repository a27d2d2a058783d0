"""Near-duplicate detection: 256-bit SimHash fingerprints, near pairs by the May-Ozerov recursion, exact verification.

1. Every text becomes its set of distinct word shingles; texts of one set are one class (exact copies end here).
2. A class has a 256-bit SimHash of its set. Two sets of Jaccard J differ in about arccos(2J/(1+J))/pi of the bits.
3. The recursion: a node of the tree takes a strip of random coordinates of its own and random centres on it; a fingerprint
   goes on to the children whose centres it differs little from on the strip (small partial weight). Close fingerprints
   share children far oftener than others, so lists shrink quickly while near pairs stay together. Lists that are short
   enough are compared pair by pair. A node has about as many centres as let a near pair meet once; the whole tree is
   repeated with other strips until the chance that a near pair meets reaches the target recall. Strip, weight, depth,
   centres and repetitions follow from the number of classes.
4. Sets of few shingles, whose fingerprints scatter, are found exactly besides: two of them are near if leaving out a few
   shingles of each makes them equal, so classes that share such a rest are linked to one of them.
5. Candidates (bits and set sizes allow the similarity) are verified on the sets themselves. Groups of near copies do not
   need all their pairs: a round tests each fingerprint's nearest candidates in *other* components only, each round
   more of them, until none is left untested between different components. So no link between components is lost.
6. A component of verified links is a group of near-duplicates; its smallest doc_id represents it.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm.common import materialise
from strandweave.llm.textkernel import U, mix, pieces, shingle_sets, text_buffer

BITS, WORDS = 256, 4


@dataclass(frozen=True)
class Near:
    """Shingle width and least similarity; recall aimed at for a pair of exactly that similarity, by
    the recursion, and standard deviations that its differing bits may exceed what is expected; most coordinates of a strip and
    centres of a node; rows of a list that is compared by brute force, in the first and in later rounds; most shingles of a set
    whose near ones are found exactly; candidates of a row that the first round tests, and by how much this grows from round to round."""

    width: int = 5
    similarity: float = 0.8
    recall: float = 0.98
    margin: float = 2.8
    strip: int = 64
    centres: int = 1500
    list_rows: int = 4096
    deep_rows: int = 512
    small: int = 14
    seed: int = 7
    first: int = 2
    grow: int = 8


# --- fingerprints ---

_SALTS = mix(np.arange(1, WORDS + 1, dtype=U) * U(0xA0761D6478BD642F))
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = (np.arange(WORDS * 8) * 256)[None, :]


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The 256-bit SimHash of a set: each bit is the majority of that bit over the hashes of its members."""
    n = len(shingles)
    counts = np.zeros(WORDS * 8 * 256, np.int64)
    for lo in range(0, n, 1 << 14):
        part = mix(shingles[lo : lo + (1 << 14), None] ^ _SALTS[None, :]).view(np.uint8).reshape(-1, WORDS * 8)
        counts += np.bincount((part + _BYTE).ravel(), minlength=len(counts))
    ones = counts.reshape(WORDS * 8, 256) @ _BIT
    return np.packbits((2 * ones > n).reshape(-1), bitorder="little").view(U)


def set_digest(shingles: np.ndarray) -> tuple[int, int]:
    a = mix(shingles ^ U(0x51ED270B))
    return int(np.add.reduce(a).view(np.int64)), int(np.add.reduce(mix(a)).view(np.int64))


def prints(docs: DataFrame, p: Near) -> DataFrame:
    """(doc_id, n, g0, g1, f0..f3, few): size, digest and fingerprint of each text's shingle set, and the set itself if it is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            size, digest, bits, few = [], [], [], []
            with np.errstate(over="ignore"):
                for lo, hi in pieces(offsets):
                    for s in shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], p.width):
                        size.append(len(s))
                        digest.append(set_digest(s))
                        bits.append(fingerprint(s).view(np.int64))
                        few.append(s.view(np.int64) if 0 < len(s) <= p.small else None)
            d = np.array(digest, np.int64).reshape(-1, 2)
            f = np.array(bits, np.int64).reshape(-1, WORDS)
            cols = [batch.column(0), pa.array(size, pa.int32()), pa.array(d[:, 0]), pa.array(d[:, 1]), *(pa.array(f[:, k]) for k in range(WORDS)), pa.array(few, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "g0", "g1", "f0", "f1", "f2", "f3", "few"])

    schema = "doc_id long, n int, g0 long, g1 long, f0 long, f1 long, f2 long, f3 long, few array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


# --- small sets ---


def left_out(n: int, similarity: float) -> int:
    """Most shingles to leave out of a set of n: another set that has the rest and nothing else would still be similar enough."""
    return max(i for i in range(n) if n - i >= similarity * n)


def rests(classes: DataFrame, p: Near) -> DataFrame:
    """(h0, h1, out, room, cid): digests of all sets that are left of a class's small set ``few`` without ``out`` of its shingles.

    Sets that share a rest of c shingles, without i and j others, have at least the similarity if and only if i + j <= room,
    the most that c allows (or they share more, and are nearer still).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            with np.errstate(over="ignore"):
                for cid, few in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    s = few.values.to_numpy().view(U)
                    a = mix(s ^ U(0x51ED270B))
                    c = mix(a)
                    for i in range(left_out(len(s), p.similarity) + 1):
                        at = np.array(list(combinations(range(len(s)), i)), int).reshape(math.comb(len(s), i), i)
                        cols[0] += (np.add.reduce(a) - a[at].sum(1, dtype=U)).view(np.int64).tolist()
                        cols[1] += (np.add.reduce(c) - c[at].sum(1, dtype=U)).view(np.int64).tolist()
                        rest = len(s) - i
                        cols[2] += [i] * len(at)
                        cols[3] += [math.floor(rest * (1 - p.similarity) / p.similarity + 1e-9)] * len(at)
                        cols[4] += [cid] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["h0", "h1", "out", "room", "cid"])

    return classes.where("few is not null").select("cid", "few").mapInArrow(run, "h0 long, h1 long, out long, room long, cid long")


def small_links(classes: DataFrame, p: Near) -> DataFrame:
    """(a, b): links of classes with small sets, to the one that leaves out least; so no group's pairs are listed."""
    own = rests(classes, p)
    stars = own.groupBy("h0", "h1").agg(F.min(F.struct("out", "cid")).alias("star"), F.count("*").alias("members")).where("members > 1")
    linked = own.join(stars, ["h0", "h1"]).where("cid <> star.cid and out + star.out <= room")
    return linked.select(F.col("star.cid").alias("a"), F.col("cid").alias("b")).distinct()


# --- the recursion ---


def _binomial(n: int, q: float) -> np.ndarray:
    return np.array([math.comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(n + 1)])


def differing(similarity: float) -> float:
    """Expected share of differing bits of two sets of equal size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


@dataclass(frozen=True)
class Levels:
    depth: int
    strip: int  #: coordinates of a node's strip
    weight: int  #: largest partial weight that passes
    centres: int  #: of a node
    repeats: int  #: of the whole tree
    bits: int  #: candidates differ in so many bits at most
    copies: float  #: of a fingerprint in lists of the last level, as expected


@functools.lru_cache(4096)
def both_pass(strip: int, weight: int) -> np.ndarray:
    """[d] chance that a centre lets both of two fingerprints pass that differ in d coordinates of the strip."""
    out = np.zeros(strip + 1)
    for d in range(strip + 1):
        same = _binomial(strip - d, 0.5).cumsum()
        for u, chance in enumerate(_binomial(d, 0.5)):  # of the differing coordinates, u count for one and d - u for the other
            left = weight - max(u, d - u)
            if left >= 0:
                out[d] += chance * same[min(left, strip - d)]
    return out


def meeting(delta: float, strip: int, weight: int, centres: int, depth: int) -> float:
    """The chance that a pair that differs in that share of bits meets in a last list of one tree. All centres of a node see
    the same differing coordinates, so the chance is taken for each number of these first."""
    differ, share, met = _binomial(strip, delta), both_pass(strip, weight), 1.0
    for _ in range(depth):  # from the last level up
        met = float((differ * (1 - (1 - share * met) ** centres)).sum())
    return met


@functools.lru_cache(64)
def levels(n: int, p: Near) -> Levels:
    """The cheapest tree whose last lists have ``p.list_rows`` of n fingerprints, as expected: the least depth with few enough
    centres, and of its strips, weights and centres those with the fewest copies."""
    delta = differing(p.similarity)
    bits = int(BITS * delta + p.margin * math.sqrt(BITS * delta * (1 - delta)))
    if n <= p.list_rows:
        return Levels(0, 0, 0, 0, 1, bits, 1.0)
    for depth in range(1, BITS // 8 + 1):
        best: Levels | None = None
        target = (p.list_rows / n) ** (1 / depth)
        for strip in range(6, min(p.strip, BITS // depth) + 1):
            passes = _binomial(strip, 0.5).cumsum()
            for weight in range(strip // 2):
                if not target / 3 <= passes[weight] <= target:
                    continue
                share = float(_binomial(strip, delta) @ both_pass(strip, weight))
                for mean in (0.5, 1, 2, 3):  # shared children of a near pair
                    centres = math.ceil(mean / share)
                    if centres > p.centres:
                        continue
                    repeats = math.ceil(math.log(1 - p.recall) / math.log1p(-meeting(delta, strip, weight, centres, depth)))
                    copies = float(repeats * (centres * passes[weight]) ** depth)
                    if best is None or copies < best.copies:
                        best = Levels(depth, strip, weight, centres, repeats, bits, copies)
        if best:
            return best
    raise ValueError(f"no tree for {n} fingerprints")


def random_words(rows: np.ndarray, salt: int) -> np.ndarray:
    """Four pseudo-random words for each name."""
    return mix(mix(rows ^ U(salt))[:, None] + _SALTS[None, :])


_STRIPS = 1024


def strips(p: Near, lv: Levels, level: int) -> np.ndarray:
    """Strips that the nodes of a level choose from: random coordinates of this level's own part of all, so that what passes one
    level says nothing about the next."""
    rng = np.random.default_rng([p.seed, level])
    own = np.random.default_rng(p.seed).permutation(BITS)[level :: lv.depth]
    on = own[np.argsort(rng.random((_STRIPS, len(own))), axis=1)[:, : lv.strip]]
    mask = np.zeros((_STRIPS, BITS), np.uint8)
    np.put_along_axis(mask, on, 1, axis=1)
    return np.ascontiguousarray(np.packbits(mask, axis=1, bitorder="little")).view(U)


def passing(f: np.ndarray, mask: np.ndarray, centre: np.ndarray, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, centre) numbers of all partial weights that are small enough; each row has a strip (mask) of its own."""
    rows, cols = [], []
    step = max(64, (1 << 18) // max(1, len(centre)))
    for lo in range(0, len(f), step):
        w = np.zeros((len(f[lo : lo + step]), len(centre)), np.uint8)
        for k in range(WORDS):
            w += np.bitwise_count((f[lo : lo + step, k, None] ^ centre[None, :, k]) & mask[lo : lo + step, k, None])
        a, b = np.nonzero(w <= weight)
        rows.append(a + lo)
        cols.append(b)
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, int), np.zeros(0, int))


def descend(f: np.ndarray, p: Near, lv: Levels, repeat: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of all lists of one repetition's last level that each fingerprint comes to."""
    at = np.arange(len(f))
    name = np.full(len(f), repeat * 0x9E3779B97F4A7C15 & (1 << 64) - 1, U)
    with np.errstate(over="ignore"):
        for level in range(lv.depth):
            centre = random_words(np.arange(1, lv.centres + 1, dtype=U), p.seed)  # a node shifts them by words of its own
            mask = strips(p, lv, level)[(mix(name ^ U(level + 1)) % U(_STRIPS)).astype(int)]
            row, child = passing(f[at] ^ random_words(name, level + 101), mask, centre, lv.weight)
            at, name = at[row], mix(name[row] + (child + 1).astype(U) * U(0xD6E8FEB86659FD93))
    return at, name


_PRINT = "cid long, n int, f0 long, f1 long, f2 long, f3 long"
_NAMES = ["cid", "n", "f0", "f1", "f2", "f3"]


def lists(classes: DataFrame, p: Near, lv: Levels) -> DataFrame:
    """(list, cid, n, f0..f3): each fingerprint in every list of the last level that it comes to, once in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                f = np.column_stack([part.column(2 + k).to_numpy() for k in range(WORDS)]).view(U)
                for repeat in range(lv.repeats):
                    at, name = descend(f, p, lv, repeat)
                    out = part.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *out.columns], names=["list", *_NAMES])

    return classes.select(*_NAMES).mapInArrow(run, f"list long, {_PRINT}")


def tiled(members: DataFrame, most: int) -> DataFrame:
    """Adds tile_a and tile_b: lists of over ``most`` rows are compared in pairs of tiles, each in a task of its own."""
    big = members.groupBy("list").count().where(F.col("count") > most)
    big = big.select(F.col("list").alias("big_list"), F.ceil(F.col("count") / most).cast("int").alias("tiles"))
    out = members.join(big, F.col("list") == F.col("big_list"), "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    out = out.withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return out.withColumns({"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")}).drop("big_list", "tiles", "other")


def close_pairs(f: np.ndarray, g: np.ndarray | None, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of f, row of g, differing bits), in blocks, of all pairs that differ in at most ``bits`` bits; without g, of f's own, each
    once. Blocks stay in the processor's cache; all words but the last rule nearly all pairs out, and it is counted for the others."""
    other = f if g is None else g
    mine, others = np.ascontiguousarray(f.T), np.ascontiguousarray(other.T)
    step = max(4, (1 << 16) // max(1, len(other)))
    for lo in range(0, len(f), step):
        first = 0 if g is not None else lo
        x, y = mine[:, lo : lo + step, None], others[:, None, first:]
        d = np.bitwise_count(x[0] ^ y[0])
        for k in range(1, WORDS - 1):
            d += np.bitwise_count(x[k] ^ y[k])
        i, j = np.divmod(np.flatnonzero(d <= bits), d.shape[1])
        if g is None:
            i, j = i[j > i], j[j > i]
        n = d[i, j].astype(np.int64)
        i, j = i + lo, j + first
        n += np.bitwise_count(mine[-1, i] ^ others[-1, j])
        near = n <= bits
        if near.any():
            yield i[near], j[near], n[near]


def nearest_first(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (row, bits, other row) and the rank of each in its row, up to rank ``most``, which tells that there are more."""
    key = np.sort(key)
    row = key >> 40
    rank = np.arange(len(key)) - np.searchsorted(row, row)
    return key[rank <= most], rank[rank <= most]


def compare(table: pa.Table, p: Near, bits: int, most: int | None) -> tuple[list[np.ndarray], np.ndarray]:
    """([a, b], more): each row's ``most`` nearest candidates in other components, and whether it has more than these.

    Candidates differ in at most ``bits`` bits, have sizes that allow the similarity, and stand in other tiles where the
    list has more than one.
    """
    cid = table.column("cid").to_numpy()
    by = np.argsort(cid, kind="stable")  # the result does not depend on the order of rows
    cid, size = cid[by], table.column("n").to_numpy()[by].astype(float)
    group = table.column("label").to_numpy()[by]
    tile = table.column("tile").to_numpy()[by]
    at, to = np.arange(len(cid)), None
    if table.num_rows and table.column("tile_a")[0].as_py() != table.column("tile_b")[0].as_py():
        at, to = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile != tile.min())
    f = np.column_stack([table.column(f"f{k}").to_numpy() for k in range(WORDS)]).view(U)[by]
    a, b, more = [], [], np.zeros(len(cid), bool)
    held, waiting = [np.zeros(0, np.int64)], 0
    for i, j, d in close_pairs(f[at], None if to is None else f[to], bits):
        i, j = at[i], (at if to is None else to)[j]
        keep = (group[i] != group[j]) & (np.minimum(size[i], size[j]) >= p.similarity * np.maximum(size[i], size[j]))
        i, j, d = i[keep], j[keep], d[keep]
        if most is None:
            a.append(cid[i])
            b.append(cid[j])
            continue
        held += [i << 40 | d << 32 | j, j << 40 | d << 32 | i]
        waiting += 2 * len(i)
        if waiting > 1 << 20:  # a row's nearest of all are among its nearest so far and those to come
            held, waiting = [nearest_first(np.concatenate(held), most)[0]], 0
    if most is not None:
        key, rank = nearest_first(np.concatenate(held), most)
        more[key[rank == most] >> 40] = True
        key = key[rank < most]
        a, b = [cid[key >> 40]], [cid[key & 0xFFFFFFFF]]
    z = np.zeros(0, np.int64)
    return [np.concatenate(a) if a else z, np.concatenate(b) if b else z], by[more]


def candidates(members: DataFrame, p: Near, bits: int, most: int | None) -> DataFrame:
    """(a, b, list, deep): pairs to verify (deep null), and rows of the lists in which cid ``deep`` has more candidates."""

    def run(table: pa.Table) -> pa.Table:
        (a, b), more = compare(table, p, bits, most)
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        pair = np.unique(np.column_stack([lo, hi]), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
        deep = table.column("cid").to_numpy()[more]
        n, m = len(pair), len(deep)
        none = pa.nulls(m, pa.int64())
        where = table.column("list")[0].as_py() if table.num_rows else None
        return pa.table({
            "a": pa.concat_arrays([pa.array(pair[:, 0]), none]), "b": pa.concat_arrays([pa.array(pair[:, 1]), none]),
            "list": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array([where] * m, pa.int64())]),
            "deep": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(deep, pa.int64())]),
        })

    return members.groupBy("list", "tile_a", "tile_b").applyInArrow(run, "a long, b long, list long, deep long")


# --- verification and components ---


def shingles(docs: DataFrame, p: Near) -> DataFrame:
    """(doc_id, g0, g1, set array<long>): the digests and shingle sets of (doc_id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            at = 0
            with np.errstate(over="ignore"):
                for lo, hi in pieces(offsets):
                    own = list(shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], p.width))
                    values = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)
                    digest = np.array([set_digest(x) for x in own], np.int64).reshape(-1, 2)
                    part = batch.column(0).slice(at, hi - lo)
                    at += hi - lo
                    yield pa.RecordBatch.from_arrays([part, pa.array(digest[:, 0]), pa.array(digest[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "g0", "g1", "set"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, g0 long, g1 long, set array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (a, b) whose sets have at least the similarity, computed on the whole sets."""
    x = sets.select(F.col("cid").alias("a"), F.col("set").alias("sa"))
    y = sets.select(F.col("cid").alias("b"), F.col("set").alias("sb"))
    both = pairs.join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component, by least-label steps with pointer jumping."""
    ends = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(edges.select(F.explode(ends).alias("e")).select("e.a", "e.b").distinct())
    label = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(label.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = label.join(seen, label.node == seen.a).select("node", F.least("label", "near").alias("to"), "label")
        jump = label.select(F.col("node").alias("to"), F.col("label").alias("far"))
        after = materialise(step.join(jump, "to").select("node", F.least("to", "far").alias("label"), (F.least("to", "far") != F.col("label")).alias("moved")))
        if after.where("moved").isEmpty():
            return after.select("node", "label")
        label = after.select("node", "label")


def near_duplicates(docs: DataFrame, p: Near = Near()) -> DataFrame:
    """(doc_id, class_id, cluster_id, keep): one row per row of ``docs``.

    class_id is the smallest doc_id of the same shingle set, cluster_id that of the near-duplicate group, and keep is
    true for the group's representative, whose doc_id is the cluster_id. Words are runs without white space, as they are;
    a text of fewer words than a shingle is one shingle; null, empty and blank texts are one class. Rows that repeat a
    doc_id each have the class of their own text; with equal texts they are copies (keep holds for each of them;
    ``representatives`` lets one row of a group pass). A row without a doc_id is a document like others; a class or group in
    which no row has one has a null id, and keep holds for its rows. Ties go to the smallest doc_id. An empty table gives no
    row; other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    own = materialise(prints(texts, p))
    firsts = [F.min("doc_id").alias("class_id"), *(F.first(c).alias(c) for c in (*_NAMES[1:], "few"))]
    classes = materialise(own.groupBy("g0", "g1").agg(*firsts).withColumn("cid", F.monotonically_increasing_id()))
    some = classes.where("n > 0")
    lv = levels(max(1, some.count()), p)
    label = some.select(F.col("cid").alias("node"), F.col("cid").alias("label")).limit(0)
    members = tiled(lists(some, p, lv), p.list_rows)
    most: int | None = p.first
    sets = tested = None
    found = materialise(candidates(members.withColumn("label", F.col("cid")), p, lv.bits, most))
    while True:
        pairs = found.where("deep is null").select("a", "b").distinct()
        deep = found.where("deep is not null")
        if sets is None:  # sets of all that will ever be verified: whoever has a candidate at all has one in the first round
            asked = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
            named = classes.join(asked, "cid", "left_semi").select("cid", "g0", "g1", F.col("class_id").alias("doc_id"))
            of_ids = shingles(texts.where("doc_id is not null").join(named.select("doc_id"), "doc_id", "left_semi"), p)
            of_nulls = shingles(texts.where("doc_id is null"), p)
            whole = of_ids.unionByName(of_nulls).join(named.withColumnRenamed("doc_id", "named_id"), ["g0", "g1"])
            sets = materialise(whole.where(F.col("doc_id").eqNullSafe(F.col("named_id"))).select("cid", "set").dropDuplicates(["cid"]))  # equal sets, whichever row stays
            deeper = deep.select("list").distinct()
            members = materialise(tiled(lists(some.join(asked, "cid", "left_semi"), p, lv).join(deeper, "list", "left_semi"), p.deep_rows))
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        edges = verified(pairs, sets, p.similarity)
        if tested is None:
            edges = edges.unionByName(small_links(some, p))
        tested = pairs if tested is None else tested.union(pairs)
        links = edges.union(label.where("node <> label").select("node", "label"))
        label = components(links)
        if most is None or deep.isEmpty():
            break
        most = most * p.grow if most * p.grow < p.list_rows else None
        named = label.select(F.col("node").alias("cid"), "label")
        grouped = members.join(named, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
        found = materialise(candidates(grouped, p, lv.bits, most))
    grouped = classes.join(label.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = grouped.groupBy("label").agg(F.min("class_id").alias("cluster_id"))
    named = grouped.join(smallest, "label").select("g0", "g1", "class_id", "cluster_id")
    out = own.select("doc_id", "g0", "g1").join(named, ["g0", "g1"])
    return out.select("doc_id", "class_id", "cluster_id", F.col("doc_id").eqNullSafe(F.col("cluster_id")).alias("keep"))


def representatives(docs: DataFrame, p: Near = Near()) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, with all its columns.

    Rows are grouped by their own texts, whatever other row has their doc_id; a group keeps a row of its smallest doc_id, or
    one without a doc_id if no row of it has any. Null, empty and blank texts are one group; texts of any length count as a
    whole; an empty table gives none; columns of any other name pass as they are (but ``row_``, which must not be there).
    """
    rows = materialise(docs.withColumn("row_", F.monotonically_increasing_id()))
    groups = near_duplicates(rows.select(F.col("row_").alias("doc_id"), "text"), p).select(F.col("doc_id").alias("row_"), "cluster_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row_"))).alias("first")
    keep = rows.select("row_", "doc_id").join(groups, "row_").groupBy("cluster_id").agg(first).select(F.col("first.row_").alias("row_"))
    return rows.join(keep, "row_", "left_semi").select(*docs.columns)
