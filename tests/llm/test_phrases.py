import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from millrace.llm.phrases import Shard, counted, phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, `hash` long, m string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, None) for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)


def grams(rows):
    out, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    out[lang, tuple(w[i : i + m])] += 1
    return out, total


def brute(rows, least, top, share=80):
    f, total = grams(rows)
    f = {k: v for k, v in f.items() if v >= least}
    most = Counter()
    for (lang, p), a in f.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                most[lang, p[i : i + n]] = max(most[lang, p[i : i + n]], a)
    out = {}
    for (lang, p), a in f.items():
        if len(p) > 1 and 100 * most[lang, p] < share * a:
            score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for lang in sorted(out) for rank, (s, a, p, left, right) in enumerate(sorted(out[lang])[:top], 1)]


def corpus(seed, n=300):
    rng = random.Random(seed)
    common = ["of the", "New York", "state of the art", "as well as", "a b c d", "É é", "日 本"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(common) if rng.random() < 0.4 else f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.randrange(60))]
        rows.append((rng.choice(["en", "en", "en", "de", None]), "".join(p + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " \r\n", "!? "]) for p in parts)))
    return rows + [("en", None), ("de", ""), ("fr", " , "), (None, "alone"), *[("en", "Echo echo ECHO echo echo; echo")] * 40]


def check(spark, rows, least, top=2000, **kw):
    got = [tuple(r) for r in phrases(frame(spark, rows), least=least, top=top, **kw).orderBy("lang", "rank").collect()]
    want = brute(rows, least, top, kw.get("share", 80))
    assert got == want
    return got


@pytest.mark.parametrize("seed, kw", [(1, {}), (2, {"shard": 2000}), (3, {"shard": 500, "bits": 64}), (4, {"share": 100, "bits": 1024})])
def test_against_brute_force(spark, seed, kw):
    """Whole and small shards; tables of bits that spare all, little and nothing."""
    assert len(check(spark, corpus(seed), 5, **kw)) > 50


def test_top_and_ties(spark):
    rows = [("en", f"p{i} q{i}, p{i} q{i}") for i in range(40)]
    got = check(spark, rows, 2, top=7)
    assert [r[2] for r in got] == [f"p{i} q{i}" for i in sorted(range(40), key=lambda i: f"p{i} q{i}")][:7]


def test_counts_are_whole(spark):
    """A phrase that no shard holds often counts over all shards."""
    rows = [("en", f"x{i} rare pair y{i}") for i in range(30)]
    got = {(r.m, r.phrase): r.n for r in counted(frame(spark, rows).select("lang", "text"), 30, 20, 1 << 12).collect()}
    assert got == {(0, ""): 120, (1, "rare"): 30, (1, "pair"): 30, (2, "rare pair"): 30}


def test_suffix_order_and_shared_words():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(12))) + rng.choice([",", "", ". a"]) for _ in range(40)]
    s = Shard(pa.array([rng.choice(["x", "y"]) for _ in texts]), pa.array(texts))
    tails = [tuple(s.ids[i : i + s.left[i]]) for i in s.order]
    assert tails == sorted(tails)
    for a, b, n in zip(tails, tails[1:], s.shared[1:].tolist(), strict=False):
        assert n == next((k for k in range(4) if k >= min(len(a), len(b)) or a[k] != b[k]), 4)


def test_empty(spark):
    assert phrases(frame(spark, [("en", "a b")]).limit(0)).count() == 0
    assert phrases(frame(spark, [("en", None), (None, "")])).count() == 0
    with pytest.raises(ValueError):
        phrases(frame(spark, [("en", "a")]), bits=100)
