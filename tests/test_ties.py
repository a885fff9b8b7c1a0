"""Rows that tie by what a query orders by: the result must not hang on the order in which they arrive."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import changes as C
from millrace.plans import graph


@pytest.mark.parametrize("ascending", [True, False])
def test_folded_chunks_take_the_last_ordinal(spark, sf, monkeypatch, ascending):
    """Both chunks of a tenth of the ids have the same seq."""
    fresh = graph.fresh_chunks
    monkeypatch.setattr(graph, "fresh_chunks", lambda *a: fresh(*a).orderBy("ordinal", ascending=ascending).coalesce(1))
    got = [(r.id, r.hash) for r in graph.folded_chunks(spark, sf).where("id % 10 = 1 AND id % 4 <> 0").collect()]
    assert got and {h for _, h in got} == {"later"}


@pytest.mark.parametrize("ascending", [True, False])
def test_upserted_breaks_ties_by_values(spark, ascending):
    rows = spark.createDataFrame([(1, "a", 5, {"k": "x"}), (1, "b", 5, {"k": "y"}), (1, "c", 4, {})], "id long, hash string, seq int, attrs map<string,string>")
    none = rows.limit(0)
    got = C.upserted(none, rows.orderBy(F.col("hash").asc() if ascending else F.col("hash").desc()).coalesce(1), ["id"], "seq").collect()
    assert [tuple(r) for r in got] == [(1, "b", 5, {"k": "y"})]
