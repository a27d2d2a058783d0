"""Operators whose work follows from the read pairs, not from the length of contigs or the square of their number."""

import numpy as np

from strandweave.operators import coverage


def dense(pairs, lengths, resolution):
    cov = {c: np.zeros(n // resolution + 1, int) for c, n in lengths.items()}
    for c, i, j in pairs:
        cov[c][max(i // resolution, 0) : j // resolution + 1] += 1
    return cov


def regions_of(cov, lengths, resolution):
    out = {}
    for c, v in cov.items():
        high = np.flatnonzero(np.diff(np.concatenate([[0], (v >= np.median(v) * 0.8).astype(int), [0]])))
        runs = list(zip(high[::2], high[1::2] - 1, strict=True))
        kept = [(a, b) for a, b in runs if (b - a + 1) * resolution >= max(40.0, lengths[c] * 0.02)] if len(runs) > 1 else []
        out[c] = kept if len(kept) > 1 else []
    return out


def breaks_of(cov, regions):
    out = set()
    for c, own in regions.items():
        low = [min((cov[c][k], k) for k in range(a[1] + 1, b[0])) for a, b in zip(own, own[1:], strict=False)]
        out |= {(c, k, v) for v, k in low if v == 0} or {(c, k, v) for v, k in sorted(low)[:1]}
    return out


def test_runs_against_bins(spark):
    rng = np.random.default_rng(8)
    lengths = {f"c{k}": int(rng.integers(100, 4000)) for k in range(40)} | {"none": 500}
    rows = []
    for c in [x for x in lengths if x != "none"]:
        for _ in range(int(rng.integers(1, 60))):
            a = int(rng.integers(0, lengths[c]))
            rows.append((c, a, min(a + int(rng.integers(0, 300)), lengths[c] + 30)))
    pairs = spark.createDataFrame([(c, a, c, b) for c, a, b in rows] + [("c0", 1, "c1", 2), ("gone", 1, "gone", 9)], "ctg_i string, pos_i long, ctg_j string, pos_j long")
    contigs = spark.createDataFrame(list(lengths.items()), "ctg string, len long")
    want = dense(rows, lengths, 10)
    runs = coverage.runs(pairs, contigs, 10)
    assert runs.count() <= 2 * len(rows) + len(lengths)
    assert {(r.ctg, r.bin, r.cov) for r in coverage.coverage(pairs, contigs, 10).collect()} == {(c, k, v) for c, own in want.items() for k, v in enumerate(own)}
    regions = coverage.high_regions(runs, contigs, 0.8, 0.02, 40, 10)
    own = regions_of(want, lengths, 10)
    assert {(r.ctg, r.first_bin, r.last_bin) for r in regions.collect()} == {(c, *x) for c, xs in own.items() for x in xs}
    found = breaks_of(want, own)
    assert len(found) > 10 and {(r.ctg, r.bin, r.cov) for r in coverage.break_points(runs, regions).collect()} == found


def test_a_contig_of_two_billion_bases(spark):
    size = 2_000_000_000
    pairs = spark.createDataFrame([("c", a, "c", b) for a, b in ((0, size // 2), (size // 2 + 100, size - 1))], "ctg_i string, pos_i long, ctg_j string, pos_j long")
    contigs = spark.createDataFrame([("c", size)], "ctg string, len long")
    runs = coverage.runs(pairs, contigs, 20)
    breaks = coverage.break_points(runs, coverage.high_regions(runs, contigs, 0.8, 0.02, 40, 20))
    assert [tuple(r) for r in breaks.collect()] == [("c", size // 40 + 1, 0)]


def test_balance_of_cells(spark):
    from strandweave.kernels import balance

    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 60):
        a = np.triu(rng.poisson(0.3, (n, n))).astype(float)
        a[np.arange(n - 1), np.arange(1, n)] += 1
        i, j = np.nonzero(a)
        full = a + np.triu(a, 1).T + 1e-5
        x = balance.balance_cells(i, j, a[i, j], n)
        assert np.allclose(x * (full @ x), 1, atol=1e-7) and np.allclose(x, balance.balance(full), rtol=1e-4)


def test_a_million_bins_are_balanced():
    from strandweave.kernels import balance

    n = 1_000_000  # as a dense matrix 8 TB
    i, j = np.arange(n - 1), np.arange(1, n)
    x = balance.balance_cells(i, j, np.ones(n - 1), n)
    y = np.bincount(i, x[j], n) + np.bincount(j, x[i], n) + 1e-5 * x.sum()
    assert np.abs(x * y - 1).max() < 1e-7


def test_clusters_take_all_links_and_contigs(spark):
    from strandweave.plans import grouped

    rng = np.random.default_rng(2)
    links = [(a, b, int(rng.integers(5, 9)) if a // 6 == b // 6 else int(rng.integers(0, 2))) for a in range(18) for b in range(a + 1, 18)]
    frame = spark.createDataFrame([x for x in links if x[2]], "ctg_i long, ctg_j long, links long")
    contigs = spark.createDataFrame([(k,) for k in range(20)], "ctg long")  # 18 and 19 have no links
    for dense in (2000, 5):
        got = {(r.ctg, r.cluster) for r in grouped.component_clusters(frame, contigs, 2.0, dense).collect()}
        assert got == {(k, k // 6 * 6) for k in range(18)} | {(18, 18), (19, 19)}


def test_columns_of_a_square():
    import pandas as pd

    from strandweave.kernels.columns import Columns

    rng = np.random.default_rng(5)
    for share in (0.02, 0.9):
        m = np.where(rng.random((300, 300)) < share, rng.integers(1, 9, (300, 300)), 0.0) + np.eye(300)
        full = (m / m.sum(0)) @ m
        for block in range(3):
            own, ks = Columns(block, 128, 300), range(300)
            row = [np.flatnonzero(m[k, block * 128 : block * 128 + 128]) + block * 128 for k in ks]
            col = [np.flatnonzero(m[:, k]) for k in ks]
            own.add(*map(pd.Series, (row, [m[k, x] for k, x in zip(ks, row, strict=True)], col, [m[x, k] for k, x in zip(ks, col, strict=True)])))
            assert np.allclose(own.sums, full[:, block * 128 : block * 128 + 128].T)


def test_streamed_sweep(spark):
    from strandweave.kernels import ordering
    from strandweave.plans import grouped

    rng = np.random.default_rng(6)
    contigs = [(k, int(rng.integers(50, 60)), int(rng.integers(3, 40)), int(rng.integers(0, 4)) if rng.random() < 0.8 else None) for k in range(60)]
    links = [(a, b, int(rng.integers(0, 30)) * (1 + 3 * ((a + b) % 4 == 0))) for a in range(60) for b in range(a + 1, 60)]
    links = [x for x in links if x[2]]
    near = {}
    for a, b, n in links:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = float(n)
    sites = {g: 1 + sum(s - 1 for _, _, s, x in contigs if x == g) for g in range(4)}
    limits = dict(least_sites=5, least_links=20, ambiguous=0.97, least_density=0.05, least_ratio=1.05)
    want = ordering.sweep([c[:3] for c in contigs], {c[0]: c[3] for c in contigs}, near, sites, **limits)
    assert sum(want[c[0]] != c[3] for c in contigs) > 10
    got = grouped.reassigned(spark.createDataFrame(links, "ctg_i long, ctg_j long, links long"), spark.createDataFrame(contigs, "ctg long, len long, re_sites long, grp long"), **limits)
    assert {r.ctg: r.grp for r in got.collect()} == want


def test_a_clique_without_edges_left():
    from strandweave.kernels import graphs

    edges = [(0, 1), (2, 4), (1, 2), (0, 4), (1, 5), (0, 3), (0, 2), (2, 5), (1, 3)]
    assert all(len(c) <= 2 for c in graphs.split_cliques({e: float(k) for k, e in enumerate(sorted(edges))}, 2))


def test_mirrored_rows_once(spark):
    from strandweave.operators import layout

    m = spark.createDataFrame([(1, 1, 5), (1, 2, 7)], "i long, j long, n long")
    assert sorted(tuple(r) for r in layout.mirrored(m).collect()) == [(1, 1, 5), (1, 2, 7), (2, 1, 7)]


def test_named_queries_shuffle_numbers(spark, sf):
    from strandweave.plans import queries as plans

    for name in ("pair_bins", "concentration_ratio", "concordance_ratio"):
        plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning(ctg" in x]
        assert exchanges and plan.count("SortMergeJoin") <= 1, name
