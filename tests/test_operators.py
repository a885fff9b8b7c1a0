"""Operators whose edge cases no table shows."""

from pyspark.sql import functions as F

from millrace.functions.text import glob_pattern, resolve_service
from millrace.operators import graph as G
from millrace.operators import predicates as P
from millrace.operators import rules as R
from millrace.sources.documents import plain_chunks
from millrace.streaming.signals import bounded, made_safe


def matches(spark, glob, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v").rlike(glob_pattern(glob))).collect()]


def test_globs(spark):
    assert matches(spark, "a[b-d]?*", "abx", "aax", "acx/y", "ad", "adzz") == [True, False, False, False, True]
    assert matches(spark, "[^a]\\*", "b*", "a*", "bc") == [True, False, False]
    assert matches(spark, "[\\]-a]", "]", "^", "b") == [True, True, False]
    assert matches(spark, "a.b", "a.b", "axb") == [True, False]
    for broken in ("[", "[a", "[]", "[a-]", "a\\"):
        assert matches(spark, broken, "a", "[", broken) == [False] * 3, broken


def test_rules_by_classes(spark):
    df = spark.createDataFrame([("web-1",), ("web-x",)], "h string")
    got = df.select(resolve_service(F.lit(""), F.create_map(F.lit("host"), F.col("h")), [("w", {"host": "WEB-[0-9]"})])).collect()
    assert [r[0] for r in got] == ["w", "unknown"]


def test_plain_chunks(spark):
    rows = [("a", b"one\ntwo"), ("b", b"x\x00y"), ("c", b" \n\t "), ("d", b""), ("e", None), ("f", b"y" * 9000 + b"\x00"), ("g", b"z" * 20000)]
    got = {r.path: (len(r.content), r.end_line) for r in plain_chunks(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {"a": (7, 2), "f": (9001, 1), "g": (16384, 1)}


def test_route_mentions(spark):
    texts = spark.createDataFrame([(1, "use Get /orders. or POST /orders/x, GET"), (2, "post /orders/x then get /orders/y"), (3, ""), (4, None), (5, "GET")], "id long, text string")
    ends = spark.createDataFrame([("a", "get /orders"), ("b", "POST /orders/x"), ("c", "GET /"), ("d", "worker")], "entity string, name string")
    assert sorted(tuple(r) for r in R.route_mentions(texts, ends).collect()) == [(1, "a", 1), (1, "b", 4), (2, "b", 0)]


def test_bounded_walk_and_ancestors(spark):
    edges = spark.createDataFrame([("hub", f"n{i:03}", "calls") for i in range(50)] + [("n000", "far", "calls"), ("hub", "hidden", "calls"), ("hidden", "behind", "calls")], "src string, dst string, kind string")
    nodes = spark.createDataFrame([(x, x == "hidden") for x in ["hub", "far", "hidden", "behind", *(f"n{i:03}" for i in range(50))]], "id string, secret boolean")
    start = spark.createDataFrame([("hub",), ("hidden",)], "id string")
    got = [(r.start, r.node, r.distance) for r in G.bounded_neighbourhood(edges, nodes, start, 2, ~F.col("secret"), 11).collect()]
    assert sorted(got) == sorted([("hub", "hub", 0)] + [("hub", f"n{i:03}", 1) for i in range(10)])
    whole = {r.node: r.distance for r in G.bounded_neighbourhood(edges, nodes, start, 2, ~F.col("secret")).collect()}
    assert whole["far"] == 2 and "behind" not in whole and len(whole) == 52
    chain = spark.createDataFrame([(i, i + 1 if i < 20 else None) for i in range(21)], "id long, parent_id long")
    up = {(r.id, r.ancestor): r.depth for r in G.ancestors(chain).collect()}
    assert up == {(i, j): j - i for i in range(21) for j in range(i + 1, 21)}
    assert max(r.depth for r in G.ancestors(chain, 5).collect()) == 5


def test_truncation_and_patches(spark):
    df = spark.range(5)
    assert [tuple(r) for r in P.with_truncation(df, ["id"], 3).collect()] == [(0, True), (1, True), (2, True)]
    assert {r.truncated for r in P.with_truncation(df, ["id"], 5).collect()} == {False}


def test_safe_events(spark):
    schema = "source string, kind string, severity string, title string, message string, exception_type string, attrs map<string,string>, stack array<struct<module:string,function:string,file:string,line:int,in_app:boolean>>, environment string, service string, external_id string, received_at timestamp, occurred_at timestamp"
    frame = ("m", "f", "a.py", 1, True)
    import datetime as dt

    now = dt.datetime(2024, 1, 1, 12)
    rows = [("Sentry", "odd", "loud", "", "first line\nsecond", "ValueError", {"stage": "Test", "x": "y" * 3000}, [frame] * 60, "", "", "", now, now + dt.timedelta(hours=1)), ("a", "alert", "critical", "t" * 600, "m", None, None, None, "Prod", "svc", "id1", now, None), (None, "error", "error", "", "", "", {}, [], "", "", "", now, now)]
    out = made_safe(spark.createDataFrame(rows, schema)).orderBy("source").collect()
    assert len(out) == 2
    a, s = out
    assert (a.severity, len(a.title), a.environment, a.service, a.external_id, a.occurred_at) == ("critical", 512, "prod", "svc", "id1", now)
    assert (s.kind, s.severity, s.title, s.environment, len(s.stack), len(s.attrs["x"]), s.occurred_at) == ("error", "error", "ValueError", "test", 50, 2048, now)
    assert s.external_id.startswith("h:") and len(s.external_id) == 34


def test_a_slow_sink_slows_the_source(spark, tmp_path):
    for i in range(4):
        spark.range(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = bounded(spark.readStream.schema("id long"), "files", 1).parquet(str(tmp_path / "in"))
    sizes = []
    q = stream.writeStream.foreachBatch(lambda df, n: sizes.append(df.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(sizes) == 4 and max(sizes) == 1
