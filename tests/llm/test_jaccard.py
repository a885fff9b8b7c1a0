import random
import re

import pytest

from millrace.llm import jaccard
from millrace.llm.components import components

SCHEMA = "doc_id long, text string, n int, token string, `key` long"


def brute(rows):
    sets = []
    for _, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where, links = {}, [0] * len(rows)
    for i, s in enumerate(sets):
        for t in s:
            where.setdefault(t, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for t in s for j in where[t] if j > i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                root[find(j)] = find(i)
                links[i] += 1
                links[j] += 1
    least = {}
    big = 1 << 62
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), big), big if d is None else d)
    return sorted((str(d), len(sets[i]), str(None if least[find(i)] == big else least[find(i)]), links[i]) for i, (d, _) in enumerate(rows))


def check(spark, rows):
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], SCHEMA).repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in jaccard.similarity_classes(df).collect())
    assert got == brute(rows)


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [word() for _ in range(30)]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.4 or not texts:
            t = [word() for _ in range(rng.choice([1, 3, 5, 6, 8, 12, 40, 120]))]
            if rng.random() < 0.5:
                t += shared[: rng.choice([6, 12, 30])]
        else:
            t = list(rng.choice(texts))
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                at = rng.randrange(len(t) + 1)
                t[at : at + rng.randrange(3)] = [word() for _ in range(rng.randrange(3))]
            if rng.random() < 0.2:
                t = t[: int(len(t) * rng.choice([0.78, 0.8, 0.82, 0.85]))]
        texts.append(t)
    rows = [(i, (" " if i % 3 else "\n").join(x.upper() if i % 5 == 0 else x for x in t)) for i, t in enumerate(texts)]
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t"), (None, rows[4][1]), (None, "alone null one two three four"), (3, rows[3][1]), (n + 3, "É a b c d e"), (n + 4, "é a b c d e")]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    check(spark, corpus(seed))


@pytest.mark.parametrize("least", [2, 5, 1 << 30])
def test_common_tokens_and_small_blocks(spark, monkeypatch, least):
    """The same links where nearly every token counts as common, blocks are small, queries are salted, and many, some or no tokens are frequent."""
    monkeypatch.setattr(jaccard, "COMMON", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    monkeypatch.setattr(jaccard, "SALT", 4)
    monkeypatch.setattr(jaccard, "FEW", 1)
    monkeypatch.setattr(jaccard, "LEAST", least)
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 200)
    check(spark, corpus(3, 200))


def test_chains_and_copies(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1000 - i, " ".join(words[i * 8 : i * 8 + 120])) for i in range(10)]  # neighbours are alike, ends are not
    check(spark, rows + [(i, "many copies of this one text") for i in range(300)])


def test_empty(spark):
    assert jaccard.similarity_classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_least_prefix_holds_for_all_sizes():
    """Sets that share exactly what they need, with the shared tokens as late as can be, share the stated prefix tokens."""
    for n in range(1, 60):
        for m in range(jaccard.needed(n), 5 * n // 4 + 1):
            share = (4 * (n + m) + 8) // 9
            assert share <= min(n, m)
            assert 9 * share >= 4 * (n + m) and share - max(jaccard.needed(n), jaccard.needed(m)) + 1 <= share
