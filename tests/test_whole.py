"""Operators over whole inputs against brute force."""

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from strandweave.operators import filters
from strandweave.plans import proxy
from strandweave.plans import queries as plans


def brute_rank_sums(links, names, top):
    both = {(a, b): n for x, y, n in links for a, b in ((x, y), (y, x))}
    ranks = {c: sorted((o for o in names if o != c), key=lambda o: (-both.get((c, o), 0), o)) for c in names}
    return {c: sum(min(ranks[a].index(b), ranks[b].index(a)) for a, b in combinations(ranks[c][:top], 2)) for c in names}


@pytest.mark.parametrize("share", [0.0, 0.05, 0.4, 1.0])
def test_rank_sums_without_a_grid(spark, share):
    rng = np.random.default_rng(4)
    names = [f"c{k:02d}" for k in rng.permutation(40)]
    links = [(a, b, int(rng.integers(1, 5))) for a, b in combinations(sorted(names), 2) if rng.random() < share]
    extra = [("c01", "other", 9)]  # a contig that is not among the names
    frame = spark.createDataFrame(links + extra, "ctg_i string, ctg_j string, links long")
    got = filters.rank_sums(frame, spark.createDataFrame([(x,) for x in names], "ctg string"), 5)
    assert {r.ctg: r.rank_sum for r in got.collect()} == brute_rank_sums(links, names, 5)


def test_rank_sums_of_all_contigs(spark, sf):
    names = [r.ctg for r in proxy.contigs(spark, sf).collect()]
    links = [(r.ctg_i, r.ctg_j, r.links) for r in plans.QUERIES["full_links"](spark, sf).collect()]
    assert {r.ctg: r.rank_sum for r in plans.QUERIES["rank_sum_all"](spark, sf).collect()} == brute_rank_sums(links, names, 5)


def whole_matrix(spark, sf):
    names = sorted(r.ctg for r in proxy.contigs(spark, sf).collect())
    at, m = {x: k for k, x in enumerate(names)}, np.eye(len(names))
    for r in plans.QUERIES["full_links"](spark, sf).collect():
        m[at[r.ctg_i], at[r.ctg_j]] = m[at[r.ctg_j], at[r.ctg_i]] = r.links
    return names, m / m.sum(0)


def inflated(m, least):
    m = m**2 / (m**2).sum(0)
    first = np.zeros_like(m, bool)
    first[np.argmax(m.round(12), 0), np.arange(len(m))] = True
    m = np.where((m >= least) | first, m, 0)
    return m / m.sum(0)


def test_clustering_step_with_all_links(spark, sf):
    names, m = whole_matrix(spark, sf)
    want = inflated(m @ m, 0.02)
    got = np.zeros_like(want)
    for r in plans.QUERIES["mcl_iteration_all"](spark, sf).collect():
        got[names.index(r.i), names.index(r.j)] = r.v
    assert np.allclose(got, want, atol=2e-6)


def test_sparse_clustering_with_all_links(spark, sf):
    names, m = whole_matrix(spark, sf)
    m = m @ m
    for n in range(12):
        m = inflated(m @ m if n else m, 0.01)
    sets = {tuple(x for x, v in zip(names, m[k], strict=True) if v > 0) for k in range(len(m)) if m[k, k] > 0}
    got = {}
    for r in plans.QUERIES["mcl_sparse"](spark, sf).collect():
        got.setdefault(r.cluster, []).append(r.ctg)
    assert sorted(map(sorted, got.values())) == sorted(map(list, sets))


def test_kmers_of_all_references(spark, sf):
    docs = proxy.sequences(spark, sf).collect()
    turn, count, own = str.maketrans("ATCG", "TAGC"), {}, {}
    for r in docs:
        s = r.seq or ""
        for p in range(len(s) - 8):
            w = s[p : p + 9]
            if "N" not in w:
                w = min(w, w.translate(turn)[::-1])
                count[w] = count.get(w, 0) + 1
                own.setdefault(f"c{int(r.name[3:]) % 3}", set()).add(w)
    got = {r.source: (r.kmers, r.n) for r in plans.QUERIES["haplotype_kmers_all"](spark, sf).collect()}
    assert got == {s: (len(ws), sum(count[w] for w in ws)) for s, ws in own.items()}


def test_backoff_with_two_words_of_context(spark, sf):
    from strandweave.llm import queries

    own = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    count = Counter(tuple(w[k : k + n]) for w in own.values() for n in (1, 2, 3) for k in range(len(w) - n + 1))
    total = sum(map(len, own.values()))

    def score(gram):
        if len(gram) == 1:
            return count[gram] / total
        return count[gram] / count[gram[:-1]] if count[gram] >= 2 else 0.4 * score(gram[1:])

    for r in queries.QUERIES["stupid_backoff_3"](spark, sf).collect():
        grams = [tuple(own[r.doc_id][max(0, k - 2) : k + 1]) for k in range(len(own[r.doc_id]))]
        assert r.n_words == len(grams) and abs(r.log_score - sum(math.log(score(g)) for g in grams)) < 1e-3
        assert r.n_backed_off == sum(len(g) > 1 and count[g] < 2 for g in grams)
