"""Streams in several micro-batches come to what one batch over the same rows comes to."""

import json

import pandas as pd
from pyspark.sql import functions as F

from millrace.operators import issues as I
from millrace.plans.issues import events
from millrace.streaming import signals, stateful


def stream_of(spark, df, folder, files):
    df.repartition(files).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_signal_stream_equals_batch(spark, sf, tmp_path):
    rows = events(spark, sf).withColumn("connector_id", F.lit("c")).withColumn("external_id", F.col("event_id").cast("string"))
    rows = rows.withColumn("occurred_at", F.col("occurred_at").cast("timestamp")).withColumn("received_at", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    twice = rows.unionByName(rows.where("event_id % 5 = 0"))
    q = signals.start(stream_of(spark, twice, f"{tmp_path}/in", 4), f"{tmp_path}/out", f"{tmp_path}/check", availableNow=True)
    q.awaitTermination(120)
    read = lambda n: spark.read.parquet(f"{tmp_path}/out/{n}")
    want = I.fold(rows).toPandas().sort_values("fingerprint", ignore_index=True)
    got = signals.issues_so_far(read("folds")).toPandas().sort_values("fingerprint", ignore_index=True)
    want["sources"], got["sources"] = want.sources.map(list), got.sources.map(list)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)
    minutes = signals.counts_so_far(read("minutes"))
    assert minutes.agg(F.sum("occurrences"), F.sum("suppressed")).first() == tuple(int(want[c].sum()) for c in ("occurrences", "suppressed"))
    first, kept = signals.samples_so_far(read("first"), read("reservoir"))
    assert first.groupBy("fingerprint").count().where("count > 5").isEmpty() and kept.groupBy("fingerprint").count().where("count > 20").isEmpty()
    whole = {tuple(r) for r in I.reservoir(rows).select("fingerprint", "event_id").collect()}
    assert {tuple(r) for r in kept.select("fingerprint", "event_id").collect()} == whole


def test_future_times_are_clamped(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:00' received_at, timestamp'2024-01-01 00:06:00' occurred_at UNION ALL SELECT timestamp'2024-01-01', timestamp'2024-01-01 00:04:00' UNION ALL SELECT timestamp'2024-01-01', null")
    assert sorted(r.occurred_at.minute for r in signals.prepared(rows).collect()) == [0, 0, 4]


def readings(spark):
    rows = []
    for h in range(30):
        rows.append(("k", "q", "lag", h * 3600, 100 + h, 0, 0, [], False))
    t = 30 * 3600
    rows += [("k", "q", "lag", t + 60 * i, 5000, 0, 0, [], False) for i in range(8)]
    rows += [("k", "q", "lag", t + 600 + 300 * i, 10, 0, 0, [], False) for i in range(5)]
    rows += [("k", "d", "dlq", 100, 5, 0, 0, ["a"], True), ("k", "d", "dlq", 200, 7, 0, 0, ["x", "b", "a", "b"], True), ("k", "d", "dlq", 300, 6, 0, 0, [], True), ("k", "d", "dlq", 400, 9, 0, 0, [], True), ("k", "s", "dlq", 100, None, 0, 0, ["z"], False), ("k", "f", "failures", 100, None, 0, 3, [], False), ("k", "f", "failures", 200, None, 0, 0, [], False)]
    return spark.createDataFrame(rows, "connector_id string, resource string, condition string, now long, backlog long, age long, failures long, classes array<string>, newest boolean")


def test_bus_rules(spark, tmp_path):
    batch = stateful.bus_events_batch(readings(spark)).toPandas()
    lag = batch[batch.resource == "q"]
    assert list(lag.event) == ["lag"] * 3 + ["resolved"] and set(lag.amount) == {1000}
    assert lag.now.iloc[0] == 30 * 3600 + 300 and lag.now.iloc[-1] == 30 * 3600 + 600 + 900
    dlq = batch[batch.event == "dlq"].sort_values(["now", "error_class"])
    assert list(zip(dlq.resource, dlq.error_class, dlq.amount)) == [("s", "z", 1), ("d", "a", 2), ("d", "b", 2), ("d", "", 3)]
    assert list(batch[batch.event == "failures"].amount) == [3]
    for part in (0, 1):  # by time, so that a key's state goes from one micro-batch to the next
        readings(spark).where(f"(now >= {30 * 3600 + 200}) = {bool(part)}").coalesce(1).write.parquet(f"{tmp_path}/in/part={part}")
    src = spark.readStream.schema(readings(spark).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    q = stateful.bus_events(src).writeStream.format("memory").queryName("bus").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM bus").toPandas()
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].values.tolist()))
    assert key(got[got.resource != "d"]) == key(batch[batch.resource != "d"])


def test_baseline_uses_completed_hours_and_nearest_rank():
    assert stateful.baseline({}, 5) == 0
    assert stateful.baseline({1: 10, 2: 30, 5: 99}, 5) == 30
    assert stateful.baseline({h: h for h in range(100)}, 100) == 94
    state = stateful.BusState(peaks={h: 1000 for h in range(10)})
    assert stateful.lag(state, 10 * 3600, 4999, 0, stateful.Thresholds(sustain=0)) == []
    assert stateful.lag(state, 10 * 3600, 5001, 1300, stateful.Thresholds(sustain=0)) == [("lag", "critical", 5000)]


def test_issue_status_stream(spark, tmp_path):
    rows = [("a", 1, 2, 0, None), ("a", 2, 0, 0, "resolve"), ("a", 3, 1, 0, None), ("b", 1, 0, 3, None), ("b", 2, 1, 0, None), ("c", 1, 1, 0, None), ("c", 2, 0, 0, "decode"), ("c", 3, 0, 5, None), ("c", 4, 1, 0, None)]
    df = spark.createDataFrame(rows, "fingerprint string, window long, occurrences long, suppressed long, command string")
    for w in range(1, 5):
        df.where(f"window = {w}").coalesce(1).write.parquet(f"{tmp_path}/in/w{w}")
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = stateful.issue_statuses(src).writeStream.outputMode("update").format("memory").queryName("statuses").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {}
    for r in spark.sql("SELECT * FROM statuses").collect():
        if r.fingerprint not in last or r.occurrences + r.suppressed >= last[r.fingerprint][1]:
            last[r.fingerprint] = (r.status, r.occurrences + r.suppressed)
    assert {k: v[0] for k, v in last.items()} == {"a": "regressed", "b": "new", "c": "decoded"}


def test_python_and_column_status_agree(spark):
    cases = [(s, o, p, d) for s in (None, "new", "resolved", "suppressed", "acknowledged", "decoded") for o in (0, 2) for p in (0, 1) for d in (True, False)]
    df = spark.createDataFrame(cases, "status string, o int, p int, d boolean")
    out = df.select("*", I.next_status(F.col("status"), F.col("o"), F.col("p"), F.col("d")).alias("n")).collect()
    assert all(r.n == stateful.next_status(r.status, r.o, r.p, r.d) for r in out)
    assert json.dumps([r.n for r in out[:2]])
