"""Queries over whole tables, on a folder that is larger than the caps of those they stand beside."""

import duckdb
import pytest

from millrace.operators import graph as G
from millrace.plans import registry

from .test_queries import rows

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["wiring"])
def test_whole(spark, name):
    con = duckdb.connect()
    for t in ("customer", "nation", "orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    df = registry.QUERIES[name](spark, FOLDER)
    assert rows(df.columns, df.collect()) == rows(columns, want.fetchall())


def test_wiring_reaches_beyond_the_first_customers(spark):
    """All but the few who point beyond the last id have links."""
    links = registry.QUERIES["wiring"](spark, FOLDER).select("source", "target").collect()
    customers = spark.read.parquet(f"{FOLDER}/customer.parquet").count()
    assert len({r.source for r in links}) >= 0.99 * customers and len({r.target for r in links}) >= 0.99 * customers


def test_system_links_have_all_owners_and_sources(spark):
    """The query's rows are held against its SQL in test_queries.py."""
    links = registry.QUERIES["system_links"](spark, "/root/testdata/sf0.001").collect()
    assert {r.kind for r in links} == {"event", "library", "api", "image", "pipeline"}
    assert len({r.source for r in links if r.kind == "event"}) > 5


def test_links_by_topic_and_edge(spark):
    entities = spark.createDataFrame([("s1", "symbol", "f", "a", None), ("s2", "symbol", "g", "a", None), ("s3", "symbol", "h", "b", None), ("e", "endpoint", "GET /", "b", None), ("old", "symbol", "x", "b", "gone"), ("t", "topic", "t", None, None)], "id string, kind string, name string, owner string, deleted_at string")
    edges = spark.createDataFrame([("s1", "t", "publishes"), ("s2", "t", "publishes"), ("s3", "t", "subscribes"), ("s3", "t", "publishes"), ("s2", "t", "subscribes"), ("s1", "s3", "calls"), ("s2", "s3", "calls"), ("s1", "e", "calls"), ("s3", "s1", "depends_on"), ("s1", "s2", "calls"), ("s1", "old", "calls")], "src string, dst string, kind string")
    named = spark.createDataFrame([("b", "a", "library", "f"), ("b", "a", "library", "lib")], "source string, target string, kind string, via string")
    got = G.system_links(G.topic_links(edges, entities.where("owner IS NOT NULL")), G.edge_links(edges, entities), named).collect()
    assert sorted((r.source, r.target, r.kind, r.via, r.links, r.first) for r in got if r.first) == [("a", "b", "api", "GET /", 1, "s1"), ("a", "b", "call", "h", 2, "s1"), ("a", "b", "event", "t", 2, "s1"), ("b", "a", "event", "t", 1, "s3"), ("b", "a", "library", "f", 2, "s3")]
    assert [(r.via, r.links) for r in got if not r.first] == [("lib", 1)]
