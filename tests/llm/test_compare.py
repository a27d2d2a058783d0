"""The comparison within lists: against brute force, and how much it computes."""

import numpy as np
import pyarrow as pa
import pytest

from strandweave.llm import simhash_dedup


def listed(n, split, centres):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, (centres, 256), dtype=np.uint8)
    bits = base[rng.integers(0, centres, n)] ^ (rng.random((n, 256)) < 0.1)
    f = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.int64)
    tile = (np.arange(n) % 2 if split else np.zeros(n)).astype(np.int32)
    cols = {"cid": rng.permutation(n) * 3, "n": rng.integers(90, 120, n).astype(np.int32), "label": rng.integers(0, n, n), "tile": tile, "tile_a": np.zeros(n, np.int32), "tile_b": np.full(n, int(split), np.int32)}
    return pa.table(cols | {f"f{k}": f[:, k].copy() for k in range(4)}), bits


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("most,centres", [(2, 30), (16, 1), (16, 30), (None, 2)])
def test_nearest_candidates(split, most, centres):
    t, bits = listed(400, split, centres)
    c = {k: t.column(k).to_numpy() for k in ("cid", "n", "label", "tile")}
    want, deep = set(), []
    for i in range(400):
        near = []
        for j in range(400):
            d = int((bits[i] != bits[j]).sum())
            if i != j and d <= 54 and c["label"][i] != c["label"][j] and (not split or c["tile"][i] != c["tile"][j]) and min(c["n"][i], c["n"][j]) >= 0.8 * max(c["n"][i], c["n"][j]):
                near.append((d, c["cid"][j]))
        want |= {tuple(sorted((int(c["cid"][i]), int(j)))) for _, j in sorted(near)[:most]}
        if most is not None and len(near) > most:
            deep.append(i)
    (a, b), more = simhash_dedup.compare(t, simhash_dedup.Near(), 54, most)
    assert {tuple(sorted(x)) for x in zip(a.tolist(), b.tolist(), strict=True)} == want and sorted(more.tolist()) == deep


@pytest.mark.parametrize("split", [False, True])
def test_pairs_are_compared_once(monkeypatch, split):
    """Of n rows, some n * n / 2 pairs are looked at, and n * n / 4 in two tiles; few of them in all their words."""
    t, _ = listed(2000, split, 2000)
    counted, count = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: (counted.append(x.size), count(x))[1])
    simhash_dedup.compare(t, simhash_dedup.Near(), 54, 2)
    assert sum(counted) < 3.2 * 2000**2 / (4 if split else 2)
