import math

import numpy as np
import pytest

from millrace.llm import multi_index
from millrace.llm.multi_index import kmeans, neighbours, search, share_needed, unit, walk

SCHEMA = "vec_id long, embedding array<float>, extra string, query string"


def brute(rows, k=5, every=50):
    good = [(i, np.array(v, dtype=np.float64)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % every:
            continue
        near = sorted({(-float(np.clip(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)), -1, 1)), i) for i, b in good if i != q and len(b) == len(a)})[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def check(found, truth, least=1.0):
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {q for q, v in truth.items() if v}
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in v}) for q, v in truth.items() if v)
    assert hits >= least * sum(map(len, truth.values()))
    for q, v in got.items():
        assert [s for _, s in v] == sorted((s for _, s in v), reverse=True)
        for (i, s), (j, t) in zip(v, truth[q], strict=True) if least == 1.0 else ():
            assert s == pytest.approx(t, abs=1e-12), (q, i, j)


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    truth = brute([(r.vec_id, r.embedding) for r in rows.collect()])
    check(search(rows, rows.where("vec_id % 50 = 0")), truth, 0.9)


def test_odd_rows_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)], "x", "y") for i in range(300)]
    same = rows[0][1]
    rows += [(i, same, None, None) for i in range(300, 700)] + [(50, same, "again", None), (900, None, "", ""), (901, [0.0] * 6, "", ""), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], "", ""), (903, [math.nan] * 6, "", ""), (904, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0], "", ""), (905, [], "", ""), (950, [1.0, 2.0], "", ""), (None, same, "", "")]
    rows = [r for r in rows if not (r[0] == 50 and r[2] == "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    truth = brute(rows)
    got = {(r.query_id, r["rank"]): r.vec_id for r in neighbours(df).collect()}
    check(neighbours(df), truth)
    assert [got[0, n] for n in range(1, 6)] == [50, 300, 301, 302, 303]
    assert [got[300, n] for n in range(1, 6)] == [0, 50, 301, 302, 303]


def test_empty(spark):
    assert neighbours(spark.createDataFrame([], SCHEMA)).count() == 0


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    cells = walk(a, b, {(i, j): 1 for i in range(9) for j in range(7)}, 10**9)
    sums = [a[i] + b[j] for i, j in cells]
    assert len(cells) == 63 and sums == sorted(sums)


def clustered(seed, n, groups, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return (centres[rng.integers(groups, size=n)] + 0.05 * rng.normal(size=(n, dims))).astype(np.float32)


def test_clustered_vectors_end_walks_early(spark):
    """Where vectors lie in clusters, a walk meets few of them and still finds the nearest."""
    x = clustered(4, 6000, 60)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(search(df, df.where("vec_id % 50 = 0")), brute(rows), 0.9)
    u = unit(x.astype(np.float64))
    assert share_needed(u, (kmeans(u[:, :8], 7), kmeans(u[:, 8:], 7)), 8, 5) < 0.25


@pytest.mark.parametrize("sent, kept, block, pack", [(0, 100_000, 16, 64), (1 << 25, 3, 8, 50), (0, 1, 4, 2048)])
def test_vectors_that_travel_and_tasks_that_tell_early(spark, monkeypatch, sent, kept, block, pack):
    for name, value in (("SENT", sent), ("KEPT", kept), ("QUERIES", block), ("PACK", pack)):
        monkeypatch.setattr(multi_index, name, value)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(clustered(5, 900, 7, 6))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    check(search(df, df.where("vec_id % 10 = 0"), share=1.0), brute(rows, every=10))
