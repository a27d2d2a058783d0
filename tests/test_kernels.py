from itertools import combinations, permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.functions import config
from strandweave.kernels import balance, chains, graphs, ordering

small = settings(max_examples=60, deadline=None)


@small
@given(st.lists(st.tuples(st.integers(-6, 6), st.integers(1, 9)), max_size=9))
def test_heaviest_increasing(rows):
    order, weight = [r[0] for r in rows], [float(r[1]) for r in rows]
    first = [k for k, v in enumerate(order) if v not in order[:k]]
    best = max((sum(weight[k] for k in c) for n in range(len(first) + 1) for c in combinations(first, n) if all(order[a] < order[b] for a, b in zip(c, c[1:], strict=False))), default=0)
    total, at = chains.heaviest_increasing(order, weight)
    assert total == best == sum(weight[k] for k in at)
    assert all(order[a] < order[b] for a, b in zip(at, at[1:], strict=False))


def test_repeats():
    assert chains.heaviest_increasing([2, 2], [1.0, 5.0]) == (1.0, [0])
    assert chains.heaviest_increasing([2, 2], [1.0, 5.0], "heavier") == (5.0, [1])
    with pytest.raises(ValueError):
        chains.heaviest_increasing([2, 2], [1.0, 5.0], "error")
    assert chains.best_rotation([3, 4, 1, 2], [1.0] * 4) == 1.0


@small
@given(st.integers(2, 12), st.integers(0, 10**6))
def test_balance(n, seed):
    a = np.random.default_rng(seed).random((n, n)) + 0.01
    a = a + a.T
    x = balance.balance(a)
    assert np.allclose(x * (a @ x), 1) and (x > 0).all()


def test_balance_refuses_empty_rows():
    with pytest.raises(ValueError):
        balance.balance(np.diag([1.0, 0.0]))
    b = balance.balanced(np.array([[2.0, 1, 0], [1, 2, 0], [0, 0, 3]]), [(0, 2)])
    assert b[0, 2] == 0 and np.isclose(b[:2, :2].sum(1), 1).all()


@small
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10**6))
def test_matching(n, m, seed):
    w = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    small_side, swap = (w, False) if n <= m else (w.T, True)
    best = max(sum(small_side[i, c] for i, c in enumerate(p)) for p in permutations(range(small_side.shape[1]), small_side.shape[0]))
    got = graphs.best_matching(w)
    assert sum(w[i, j] for i, j in got) == best and len(got) == min(n, m)


@small
@given(st.sets(st.tuples(st.integers(0, 6), st.integers(0, 6)).filter(lambda e: e[0] < e[1]), max_size=14))
def test_cliques(edges):
    nodes = sorted({x for e in edges for x in e})
    full = lambda c: all(p in edges for p in combinations(c, 2))
    cliques = [c for n in range(1, len(nodes) + 1) for c in combinations(nodes, n) if full(c)]
    want = sorted(list(c) for c in cliques if not any(set(c) < set(d) for d in cliques))
    assert graphs.maximal_cliques(sorted(edges)) == want
    assert all(len(c) <= 2 for c in graphs.split_cliques({e: float(k) for k, e in enumerate(sorted(edges))}, 2))


def test_clustering_finds_planted_groups():
    truth = np.repeat(np.arange(3), 20)
    rng = np.random.default_rng(1)
    m = rng.poisson(np.where(truth[:, None] == truth[None, :], 40, 0.5)).astype(float)
    m = np.triu(m, 1)
    m = m + m.T + np.eye(60)
    limit = graphs.markov(m, 2.0)
    assert np.allclose(limit.sum(0), 1)
    assert graphs.clusters_of(limit) == [list(range(0, 20)), list(range(20, 40)), list(range(40, 60))]
    d = m.max() - m
    assert graphs.average_linkage(d, 3) == truth.tolist()


def planted(n=6, seed=3):
    rng = np.random.default_rng(seed)
    names = [f"c{k}" for k in rng.permutation(n)]
    orient = rng.choice(["+", "-"], n)
    lengths = {c: 100.0 for c in names}
    ends = [(c, h) for c, o in zip(names, orient, strict=True) for h in (("H", "T") if o == "+" else ("T", "H"))]
    links = {}
    for a, b in combinations(range(len(ends)), 2):
        if ends[a][0] != ends[b][0]:
            links[ends[a], ends[b]] = 1000.0 / (b - a) ** 2
    return list(zip(names, orient, strict=True)), lengths, links


@pytest.mark.parametrize("seed", range(5))
def test_fast_order_restores_planted_order(seed):
    path, lengths, links = planted(seed=seed)
    got = ordering.fast_order(lengths, links)
    turned = [(c, "-" if o == "+" else "+") for c, o in reversed(got)]
    assert [(c, str(o)) for c, o in path] in (got, turned)


def test_sweep_moves_and_rescues():
    contigs = [("a", 10, 30), ("b", 9, 30), ("x", 8, 30), ("y", 7, 30)]
    links = {"x": {"a": 100.0, "b": 2.0}, "a": {"x": 100.0}, "b": {"x": 2.0, "y": 1.0}, "y": {"b": 1.0}}
    after = ordering.sweep(contigs, {"a": "A", "b": "B", "x": None, "y": "B"}, links, {"A": 30.0, "B": 59.0})
    assert after == {"a": "A", "b": "B", "x": "A", "y": "B"}


def test_refined_never_loses():
    path, _, _ = planted()
    d = {(a, b): [1, 2, 3] for a, b in zip(path, path[1:], strict=False)}
    bad = [path[0], path[3], path[2], path[1], *path[4:]]
    assert ordering.path_score(ordering.refined(bad, d), d) >= ordering.path_score(bad, d)


def test_config():
    assert config.Limit.parse("1.9X") == config.Limit(1.9, True)
    assert config.Limit.parse("0.2") == config.Limit(0.2, False)
    with pytest.raises(ValueError):
        config.Limit.parse("1.2")
    assert [str(x) for x in config.steps("1.1", "1.3", "0.1")] == ["1.1", "1.2", "1.3"]
    assert config.automatic_bin(10**12, 10) == 2_000_000
