"""Large groups of equal vectors in one shard."""

import numpy as np

from strandweave.llm import vptree


def test_copies_beyond_k_go_by_their_ids():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 61))
    x[rng.permutation(2000)[:1500]] = rng.normal(size=(3, 61)).repeat(500, axis=0)
    ids, at = rng.permutation(2000), np.arange(0, 2000, 3)
    score = vptree.exact_scores(x, np.repeat(at, 2000), x, np.tile(np.arange(2000), len(at))).reshape(len(at), -1)
    q, v, got, _ = vptree.search_shard(ids[at], x[at], ids, x, vptree.Search(k=20))
    for k, a in enumerate(at):
        want = sorted((-score[k, b], ids[b]) for b in range(2000) if b != a)[:20]
        own = q == ids[a]
        assert sorted(zip((-got[own]).tolist(), v[own].tolist(), strict=True)) == want
