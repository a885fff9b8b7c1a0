import hashlib
import random
import re
import zlib

import pytest

from millrace.llm.periodic_runs import periodic_runs, planted_runs

SCHEMA = "doc_id long, text string, runs string, n_words int, `key` long, period string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, None) for i, t in rows], SCHEMA).repartition(3)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, least=12):
    """Runs by comparing all words at each distance; of equal intervals the smallest period."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def made(rng, n):
    """Words with repetitions of many periods, some inside others, some cut short."""
    out = []
    while len(out) < n:
        p = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 20))]
        out += (p * rng.randrange(1, 6))[: rng.randrange(1, 80)]
        if rng.random() < 0.5:
            out += [f"w{rng.randrange(500)}" for _ in range(rng.randrange(30))]
        if rng.random() < 0.3:
            out += out[-rng.randrange(1, 60) :] * 2
    return out[:n]


def check(spark, rows, least=12):
    out = periodic_runs(frame(spark, rows), least=least)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    want = sorted(((i is None, i or 0), len(w := split(t)), brute(w, least), collapsed(w, brute(w, least))) for i, t in rows)
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out.collect())
    assert got == want
    return want


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(made(rng, rng.randrange(1, 300)))) for i in range(90)]
    assert sum(len(r[2]) for r in check(spark, rows)) > 100
    if not seed:
        check(spark, rows, least=20)


def test_two_letters_and_nested_periods(spark):
    rng = random.Random(5)
    fib = ["a", "ab"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    thue = "a"
    while len(thue) < 500:
        thue += thue.translate(str.maketrans("ab", "ba"))
    rows = [(i, " ".join(rng.choice("ab") for _ in range(200))) for i in range(30)]
    rows += [(100, " ".join(fib[-1])), (101, " ".join(thue)), (102, "z " * 700), (103, ("a b " * 40 + "c ") * 5), (104, " ".join("é日x"[i % 3] for i in range(50)))]
    check(spark, rows)


def test_edges(spark):
    """Shortest runs and ones just too short, empty rows between others, repeats, missing ids."""
    rows = [(1, " ".join(["a b c d e f"] * 2)), (2, "a b c d e f a b c d e"), (3, "x " * 11), (4, "x " * 12), (5, None), (6, ""), (7, " \n "), (8, "one"), (None, "y " * 20), (4, "x " * 12), (9, "q r s t u v w " * 2)]
    want = check(spark, rows)
    assert [r[2] for r in want if r[0] == (False, 1)] == [[(0, 12, 6)]] and [r[2] for r in want if r[0] == (False, 3)] == [[]]
    assert periodic_runs(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(frame(spark, rows), least=8)


def test_long_text(spark):
    """Far more words than a batch; the run over all of it, and one inside."""
    text = " ".join(f"w{i % 40000}" if i % 50000 > 60 else "v" for i in range(200_000)) + " z" * 3000
    [r] = periodic_runs(frame(spark, [(1, text)])).collect()
    assert [tuple(x) for x in r.runs][-1] == (200_000, 3000, 1)


def rewritten(i, w):
    h = zlib.crc32(str(i).encode())
    n, g = len(w), h // 10
    if i is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 12_000] + [(-7, "a b c " * 30), (None, "a b " * 9), (28, None), (10**12, "  ")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        w = rewritten(i, split(t))
        runs = brute(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        own = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((str(i), len(runs), own, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs))))
    got = [(str(r.doc_id), r.n_runs, (r.start, r.length, r.period, r.exponent_milli), r.runs_sha256, r.collapsed_sha256) for r in planted_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 10
