import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import repeats
from millrace.llm.automata import Automaton, substring_dedup
from millrace.llm.prefix_free import corpus_order, solve, suffix_dedup

SCHEMA = "doc_id long, text string, removed string, kept int, `key` long, anchor string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, i, None) for i, t in rows], SCHEMA).repartition(3)


def brute_words(rows, width):
    split = [(np.inf if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in split:
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            least[k] = min(least.get(k, np.inf), i)
    out = []
    for i, w in split:
        gone = {a + j for a in range(len(w) - width + 1) if least[tuple(w[a : a + width])] < i for j in range(width)}
        out.append((None if i == np.inf else i, len(w), len(gone), " ".join(x for a, x in enumerate(w) if a not in gone)))
    return Counter(out)


def brute_bytes(rows, width):
    raw = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(b[a : a + width] for _, b in raw for a in range(len(b) - width + 1))
    out = []
    for i, b in raw:
        gone = np.zeros(len(b) + 2, dtype=bool)
        for a in range(len(b) - width + 1):
            if times[b[a : a + width]] > 1:
                gone[a + 1 : a + 1 + width] = True
        out.append((i, len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), b"".join(b[a : a + 1] for a in range(len(b)) if not gone[a + 1])))
    return Counter(out)


def check_words(spark, rows, width=13):
    got = substring_dedup(frame(spark, rows), width=width).collect()
    assert Counter((r.doc_id, r.n_words, sum(s.stop - s.start for s in r.removed), r.kept) for r in got) == brute_words(rows, width)


def check_bytes(spark, rows, width=400):
    got = suffix_dedup(frame(spark, rows), width=width).collect()
    assert Counter((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.removed), len(r.removed), bytes(r.kept)) for r in got) == brute_bytes(rows, width)


def corpus(seed, words, n, longest):
    rng = random.Random(seed)
    passages = [[rng.choice(words) for _ in range(rng.randrange(1, 60))] for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, longest)):
            p = list(rng.choice(passages)) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(30))]
            if rng.random() < 0.3 and p:
                p[rng.randrange(len(p))] = "changed"
            a = rng.randrange(len(p) + 1)
            parts += p[a:] + p[:a] if rng.random() < 0.3 else p
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(rng.randrange(n), rows[5][1]), (rows[7][0], rows[7][1]), (n + 1, None), (n + 2, ""), (n + 3, " \n "), (None, rows[3][1]), (n + 4, "z" * 3000), (n + 5, "z " * 900), (n + 6, rows[9][1] + " tail")]
    return rows


def test_words_against_brute_force(spark):
    check_words(spark, corpus(1, [f"w{i}" for i in range(400)], 120, 8))
    check_words(spark, corpus(2, ["a", "b"], 60, 4))
    check_words(spark, corpus(3, ["é", "日本", "a b", "x"] + [f"w{i}" for i in range(40)], 80, 6), width=5)


def test_bytes_against_brute_force(spark):
    check_bytes(spark, corpus(4, [f"word{i}" for i in range(900)], 120, 12))
    check_bytes(spark, corpus(5, ["ab", "ba"], 50, 5), width=40)
    check_bytes(spark, corpus(6, ["é", "日本", "x"] + [f"w{i}" for i in range(40)], 80, 6), width=60)


@pytest.mark.parametrize("least, shard", [(3, 4096), (12, 5), (1 << 30, 2)])
def test_hot_anchors(spark, monkeypatch, least, shard):
    """The same windows where many or some anchors and contents are hot, or none is but most have too many segments for a solver."""
    for name, value in (("HOT", 0.0), ("LEAST", least), ("SHARD", shard)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(130)]
    rows = corpus(9, [f"w{i}" for i in range(400)], 60, 8)
    rows += [(1000 + i, " ".join([f"q{rng.randrange(5)}" for _ in range(rng.randrange(20))] + passage[rng.randrange(9) :] + [f"r{rng.randrange(5)}" for _ in range(rng.randrange(20))])) for i in range(80)]
    check_words(spark, rows)
    check_bytes(spark, rows)


@pytest.mark.parametrize("shard", [4096, 1])
def test_segments_within_a_text_go_once(spark, monkeypatch, shard):
    """A text that says a passage over and over sends each of its windows once, to a solver or by itself."""
    sent = []
    stored = repeats.stored

    def kept(df, name):
        out = stored(df, name)
        if name == "sent":
            sent.append(out)
        return out

    monkeypatch.setattr(repeats, "stored", kept)
    monkeypatch.setattr(repeats, "SHARD", shard)
    passage = [f"p{i}" for i in range(200)]
    rows = [(i, " ".join([*passage, f"own{i}"] * 6 + passage[: 150 - i])) for i in range(4)] + [(9, " ".join(passage[20:] + ["end"]))]
    check_words(spark, rows)
    check_bytes(spark, rows)
    assert len(sent) == 2
    for df in sent:
        assert df.count() == df.distinct().count() > 0


def test_windows_of_repeated_ids_come_back_once(spark):
    rows = [(1, key, content, None, n, 100 + n) for key, content in ((5, 7), (5, 7), (6, 8)) for n in range(3)]
    sent = spark.createDataFrame(rows, "anchor long, key long, content long, units binary, n int, window long")
    got = {r.key: [(s.content, sorted(s["at"])) for s in r.solved] for r in repeats.settled(sent, repeats.Plan(repeats.octets, 400, 160, False, solve)).collect()}
    assert got == {5: [(7, [0, 1, 2])], 6: [(8, [0, 1, 2])]}


def test_whole_copies_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(200))
    check_words(spark, [(i, text) for i in range(300)])
    check_bytes(spark, [(1, text)] * 300)
    for run in (substring_dedup, suffix_dedup):
        assert run(frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_automaton_gives_matching_statistics():
    rng = random.Random(7)
    for _ in range(200):
        texts = [[rng.choice("ab") for _ in range(rng.randrange(12))] for _ in range(4)]
        query = [rng.choice("abc") for _ in range(15)]
        a = Automaton()
        for t in texts:
            a.add(t)
        joined = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        assert a.matches(query) == [max(n for n in range(i + 2) if n == 0 or tuple(query[i + 1 - n : i + 1]) in joined) for i in range(len(query))]


@pytest.mark.parametrize("seed", range(4))
def test_corpus_order_is_the_suffix_order(seed):
    rng = random.Random(seed)
    pieces = [bytes(rng.choice(b"abc" if seed % 2 else bytes(range(256))) for _ in range(rng.randrange(1, 600))) for _ in range(6)]
    pieces += [pieces[0] + pieces[1], pieces[0]]
    first = np.cumsum([0, *map(len, pieces)])[:-1]
    starts = np.arange(sum(map(len, pieces)))
    suffix = [p[i:] for p in pieces for i in range(len(p))]
    order = corpus_order(pieces, starts, first)
    assert [suffix[i] for i in order] == sorted(suffix)
