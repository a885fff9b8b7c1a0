import re

import pytest
from pyspark.sql import functions as F

from millrace.llm.mixing import mixed, mixing, permuted, placed

SCHEMA = "doc_id long, text string, source string, size string, target int"


def expected_targets(rows):
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    left = float(total)
    while free:  # share, cut what is above, share the excess again
        w = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / w > 3 * sizes[s]}
        if not above:
            target |= {s: left * weight[s] / w for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in above}
        left -= sum(3 * sizes[s] for s in above)
        free -= above
    return sizes, target


def check(spark, rows, block):
    df = spark.createDataFrame(rows, SCHEMA)
    sizes, target = expected_targets(rows)
    out = mixing(df, block).collect()
    assert sorted(x.doc_id if x.doc_id is not None else -1 for x in out) == sorted(r[0] if r[0] is not None else -1 for r in rows)
    by_size = {}
    for r in rows:
        by_size.setdefault(r[0], []).append((r[2], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))))
    taken = {}
    for x in out:
        source = next(s for s, n in by_size[x.doc_id] if n == x["size"])
        assert x.source_size == sizes[source] and x.target == pytest.approx(target[source])
        assert 0 <= x.taken <= 3 * x["size"]
        taken[source] = taken.get(source, 0) + x.taken
    for s in sizes:
        assert taken[s] == int(target[s] + 0.5)
    assert sorted(map(str, mixing(df, block).collect())) == sorted(map(str, out))


def test_targets_and_taken(spark):
    rows = [(i, "w " * (i * 7 % 50), f"s{i % 7}" if i % 7 else None, "clash", 0) for i in range(400)]
    rows += [(1000 + i, "x\ty\x0bz z " * 900, "big", None, None) for i in range(5)] + [(2000, "one", "alone", "", 1), (2001, None, "alone", "", 1), (2002, "", "nothing", "", 1), (7, "w " * 48, "s0", "", 1), (None, "a b", "s1", "", 1)]
    for block in (4, 64, 1024):
        check(spark, rows, block)


def test_repeated_rows(spark):
    check(spark, [(1, "a b c d", "s", "", 1)] * 50 + [(2, "e", "t", "", 1)] * 3, 2)


def test_slots_take_each_block_once_a_pass(spark):
    df = spark.createDataFrame([(i, "a b c", "s" if i else "t", "", 0) for i in range(200)], SCHEMA)
    out = mixed(placed(df, block=8), block=8, shard_blocks=10)
    assert out.groupBy("source_no", "epoch", "block").agg(F.countDistinct("slot").alias("n")).where("n > 1").count() == 0
    assert out.select("shard").distinct().count() > 3


def test_shards_draw_their_sources(spark):
    """Every shard is full but the last, and its counts of a source spread as a multinomial draw given the totals does."""
    rows = [(i, "w " * 40, ("a", "b", "b", "c", "c", "c")[i % 6], "", 0) for i in range(3000)]
    slots = mixed(placed(spark.createDataFrame(rows, SCHEMA), block=20), block=20, shard_blocks=50).select("shard", "place", "source_no").distinct().collect()
    n = len(slots)
    assert sorted(r.place for r in slots) == list(range(n)) and all(r.shard == r.place // 50 for r in slots)
    shards = n // 50
    for source in range(3):
        p = sum(r.source_no == source for r in slots) / n
        counts = [sum(r.source_no == source and r.shard == k for r in slots) for k in range(shards)]
        mean = sum(counts) / shards
        spread = sum((c - mean) ** 2 for c in counts) / shards
        assert 0.6 < spread / (50 * p * (1 - p) * (n - 50) / (n - 1)) < 1.5


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixing(df).count() == 0
    assert [(x.taken, x.target) for x in mixing(spark.createDataFrame([(1, None, None, "", 0), (2, " ", "a", "", 0)], SCHEMA)).collect()] == [(0, 0.0)] * 2


def test_permuted_is_a_permutation(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), F.lit(1))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))
