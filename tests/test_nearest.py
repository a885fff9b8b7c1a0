import numpy as np
import pytest

from millrace.operators import retrieval as R

SCHEMA = "id long, vector array<float>"


def vectors(seed, n, groups, spread=0.05, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return (centres[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], SCHEMA).repartition(3)


def check(got, x, q, k, least=None, first=0):
    u, a = (v.astype(np.float64) / np.maximum(np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True), 1e-300) for v in (x, q))
    rows = {}
    for r in got.orderBy("query_id", "rank").collect():
        rows.setdefault(r.query_id, []).append((r.id, r.score))
    for i, own in enumerate(a @ u.T):
        want = sorted(range(len(x)), key=lambda j: (-round(own[j], 12), j))[:k]
        want = [j for j in want if least is None or own[j] >= least]
        assert [j for j, _ in rows.get(first + i, [])] == want and np.allclose([s for _, s in rows.get(first + i, [])], own[want], atol=1e-12)


@pytest.mark.parametrize("block, sample", [(16_384, 4096), (20, 50), (7, 3)])
def test_against_brute_force(spark, monkeypatch, block, sample):
    for name, value in (("QUERY_BLOCK", block), ("SAMPLE", sample), ("PACK", 40)):
        monkeypatch.setattr(R, name, value)
    x, q = vectors(1, 700, 9), vectors(2, 60, 60, 1.0)
    q[3] = 0
    check(R.nearest(frame(spark, x), frame(spark, q, 1000), 5), x, q, 5, first=1000)
    check(R.nearest(frame(spark, x), frame(spark, q), 5, least=0.6), x, q, 5, 0.6)


def test_few_of_clustered_chunks_are_met(spark, monkeypatch):
    """Queries near clusters are compared with a small share of all chunks; those of no structure with most."""
    monkeypatch.setattr(R, "PACK", 100)
    share = {}
    for spread in (0.03, 3.0):
        x = vectors(3, 6000, 40, spread, 12)
        met = spark.sparkContext.accumulator(0)
        check(R.nearest(frame(spark, x), frame(spark, x[:100]), 5, met=met), x, x[:100], 5)
        share[spread] = met.value / (len(x) * 100)
    assert share[0.03] < 0.1 and share[3.0] > 0.3


def test_ties_zeros_and_nothing(spark):
    x = np.ones((50, 3), np.float32)
    x[7] = 0
    check(R.nearest(frame(spark, x), frame(spark, x[:2]), 4), x, x[:2], 4)
    few = frame(spark, x[:2])
    assert R.nearest(few, few.limit(0), 3).count() == 0 and R.nearest(few.limit(0), few, 3).count() == 0
    check(R.nearest(few, few, 9), x[:2], x[:2], 9)
