"""Rows without an id, and rows that differ under one id, in the pipeline's stages."""

import random
import re
from collections import Counter

import corpus_pipeline
from millrace.llm.mixing import mixed_documents

from .test_mixing import expected_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


def test_mix_takes_each_row_by_itself(spark):
    """Every word belongs to one row: a whole pass takes it once, whatever the row's id, and sources come to their targets."""
    rows = [(None, "a", 5, "s"), (None, "b", 90, "s"), (None, "c", 40, "t"), (7, "d", 3, "s"), (7, "e", 70, "s"), (7, "f", 20, "t"), (8, "g", 33, None), (None, "h", 17, None), (9, "i", 64, "t")]
    docs = [(d, " ".join(words(p, n)), "en", s, 0) for d, p, n, s in rows]
    docs += [(None, docs[2][1], "en", "t", 0), docs[5]]
    sizes, target = expected_targets([(d, t, s) for d, t, _, s, _ in docs])
    copies = Counter(w for d in docs for w in d[1].split())
    for block in (4, 16):
        taken = {s: Counter() for s in sizes}
        for r in mixed_documents(spark.createDataFrame(docs, SCHEMA).repartition(3), block=block).collect():
            taken[r.source].update(re.findall(r"\S+", r.text))
        for s, size in sizes.items():
            wanted = int(target[s] + 0.5)
            assert sum(taken[s].values()) == wanted
            for _, text, _, source, _ in docs:
                if source == s:
                    assert all(copies[w] * (wanted // size) <= taken[s][w] <= copies[w] * -(-wanted // size) for w in text.split())


def test_one_of_each_without_ids(spark):
    base, other, third = words("a", 60), words("b", 60), words("c", 60)
    near = lambda w, at: " ".join([*w[:at], "changed", *w[at + 1 :]])
    docs = [
        (None, " ".join(base), "en", "s", 0), (None, near(base, 59), "en", "s", 0), (None, " ".join(base), "de", "s", 0),  # a group without ids
        (None, near(other, 0), "en", "s", 0), (5, " ".join(other), "en", "s", 0),  # one with an id, one without
        (6, " ".join(third), "en", "s", 0), (6, near(third, 59), "en", "s", 0),  # one id, alike
        (5, "something else entirely under the id of another text", "en", "s", 0), (7, near(other, 59), "en", "s", 0), (7, "one more text that is alike to nothing at all", "en", "s", 0),
        (None, None, "en", "s", 0), (8, "", "en", "s", 0), (8, "", "en", "s", 0),
    ]
    got = [(r.doc_id, (r.text or "")[:4]) for r in corpus_pipeline.one_of_each(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), "").collect()]
    assert sorted(got, key=str) == sorted([(None, "a0 a"), (5, "b0 b"), (6, "c0 c"), (5, "some"), (7, "one "), (None, ""), (8, "")], key=str)


def test_stages_on_empty_tables_nulls_and_clashing_columns(spark):
    schema = SCHEMA + ", key long, block long, size string, shard int, label string, kind string, token string, row string, `__text` string"
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    long = " ".join(words("a", 70)) + "."
    rng = random.Random(3)
    known = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(2000)]
    prose = " ".join(rng.choice(known) for _ in range(9000))
    rows = [(1, long, None, None, None), (None, long, "en", "s", 3), (2, None, "en", "s", 0), (3, "", "en", None, 0), (4, prose, "en", "t", 1), (4, prose, "en", "t", 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3, "y", "z", "t", "r", "u") for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), schema)
    assert sorted(r.doc_id for r in docs.collect()) == [1, 1, 1, 4]  # a small source comes three times
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 4
