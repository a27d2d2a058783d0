"""The ranking learns from every row and every pair."""

import numpy as np

from strandweave.llm import pairwise_rank


def test_weights_and_threshold_of_all_rows(spark):
    """10,000 rows, those of label 0 far more than any former sample: weights of all pairs, and a threshold at their share."""
    rng = np.random.default_rng(3)
    x = rng.random((10_000, pairwise_rank.N_FEATURES)).round(4)
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=len(x)) * 0.3 > 1.6).astype(int)
    ids = [k for k in range(20_000) if __import__("zlib").crc32(str(k).encode()) % 5][: len(x)]
    rows = spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist(), strict=True)], "doc_id long, x array<double>").repartition(3)
    labels = spark.createDataFrame([(i, int(v)) for i, v in zip(ids, y, strict=True)], "doc_id long, quality int")
    m = pairwise_rank.fit(rows, labels, pairwise_rank.Ranking())
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scale, x.std(0))
    z = (x - x.mean(0)) / x.std(0)
    raw = z @ m.weights
    better, worse = z[y == 1], z[y == 0]
    gradient = 1e-3 * m.weights  # of the mean loss over all pairs
    for i in range(len(better)):
        d = better[i] - worse
        gradient += d.T @ (1 / (1 + np.exp(-(d @ m.weights))) - 1) / (len(better) * len(worse))
    assert len(worse) > 4000 and np.abs(gradient).max() < 1e-4
    assert ((m(x) >= 0.3).sum(), (raw >= m.threshold).sum()) == (y.sum(), y.sum())
