"""Vectors whose trees leave nothing out."""

import numpy as np

from strandweave.llm import vptree


def test_useless_trees_are_scanned(monkeypatch):
    """Results are exact, and a query meets few large blocks instead of every small leaf."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64)).round(3)
    x[100:140] = x[60]
    ids, at = rng.permutation(4000), np.arange(0, 4000, 5)
    offered, offer = [], vptree.Best.offer
    monkeypatch.setattr(vptree.Best, "offer", lambda self, a, rows: (offered.append(len(a)), offer(self, a, rows))[1])
    q, v, got, _ = vptree.search_shard(ids[at], x[at], ids, x, vptree.Search())
    for a in at[::7]:
        score = vptree.exact_scores(x, np.full(4000, a), x, np.arange(4000))
        want = sorted((-score[b], ids[b]) for b in range(4000) if b != a)[:20]
        own = q == ids[a]
        assert sorted(zip((-got[own]).tolist(), v[own].tolist(), strict=True)) == want
    assert len(q) == 20 * len(at) and sum(offered) < 16 * len(at)
