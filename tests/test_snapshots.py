import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators.snapshots import assigned, change_feed, moved_whole, similar_pairs


def frame(spark, files):
    return spark.createDataFrame([(p, c) for p, c in files.items()], "path string, content string").repartition(3)


def brute(a, b):
    x, y = (Counter(line for line in (c or "").split("\n") if line) for c in (a, b))
    weigh = lambda c: sum(n * (len(line.encode()) + 1) for line, n in c.items())
    larger = max(weigh(x), weigh(y))
    return 100 * weigh(x & y) // larger if larger else 0


def tree(seed, n, words=30):
    rng = random.Random(seed)
    common = ["", "}", "import x", "é" * 5]
    return {f"d{i % 5}/f{i}": "\n".join(rng.choice(common) if rng.random() < 0.4 else f"line {rng.randrange(words)}" * rng.randrange(1, 4) for _ in range(rng.randrange(14))) for i in range(n)}


@pytest.mark.parametrize("seed, least", [(1, 50), (2, 50), (3, 80), (4, 20)])
def test_pairs_against_brute_force(spark, seed, least):
    gone, come = tree(seed, 60), {f"n/{p}": c for p, c in tree(seed + 100, 50).items()} | {"n/same": tree(seed, 60)["d0/f5"]}
    got = {(r.old_path, r.path): r.similarity for r in similar_pairs(frame(spark, gone), frame(spark, come), least).collect()}
    want = {(p, q): s for p, a in gone.items() for q, b in come.items() if (s := brute(a, b)) >= least}
    assert got == want and len(want) >= 2


def test_assignment_is_the_best_again_and_again(spark):
    rng = random.Random(5)
    pairs = [(f"o{rng.randrange(25)}/x{a % 4}", f"n{rng.randrange(25)}/x{a % 3}", rng.choice([50, 60, 60, 90])) for a in range(200)]
    pairs = list({(a, b): s for a, b, s in pairs}.items())
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs], "old_path string, path string, similarity int")
    order = [tuple(r) for r in df.orderBy(F.desc("similarity"), F.desc(F.substring_index("old_path", "/", -1) == F.substring_index("path", "/", -1)), F.xxhash64("old_path", "path")).collect()]
    taken, used = set(), set()
    for a, b, s in order:
        if a not in used and ("n", b) not in used:
            taken.add((a, b, s))
            used |= {a, ("n", b)}
    assert {tuple(r) for r in assigned(df).collect()} == taken


def test_equal_files_meet_by_name_then_by_place(spark):
    rows = lambda paths: spark.createDataFrame([(p, "h", p.split("/")[-1]) for p in paths], "path string, hash string, name string")
    got = moved_whole(rows(["a/x", "a/y", "b/x", "c/z"]), rows(["q/y", "q/x", "q/w"])).collect()
    assert {tuple(r) for r in got} == {("a/x", "q/x"), ("a/y", "q/y"), ("b/x", "q/w")}


def test_feed(spark):
    body = "\n".join(f"value {i}" for i in range(20))
    old = {"keep": "same", "edit": "one", "gone": "nothing\nlike it", "src/a.go": body, "src/b.go": body + "\nb", "empty": "", "null": None}
    new = {"keep": "same", "edit": "two", "lib/a.go": body, "lib/c.go": body.replace("value 3", "other") + "\nb", "fresh": "brand new", "void/empty": ""}
    got = {r.path: (r.status, r.old_path, r.similarity) for r in change_feed(frame(spark, old), frame(spark, new)).collect()}
    assert got == {
        "edit": ("modified", None, None), "gone": ("deleted", None, None), "fresh": ("added", None, None), "lib/a.go": ("renamed", "src/a.go", 100), "lib/c.go": ("renamed", "src/b.go", brute(old["src/b.go"], new["lib/c.go"])),
        "void/empty": ("renamed", "empty", 100), "null": ("deleted", None, None),
    }
    assert change_feed(frame(spark, old), frame(spark, old)).count() == 0
    nothing = frame(spark, old).limit(0)
    assert {r.status for r in change_feed(nothing, frame(spark, new)).collect()} == {"added"} and {r.status for r in change_feed(frame(spark, old), nothing).collect()} == {"deleted"}
