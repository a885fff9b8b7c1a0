"""Sources that acknowledge and cursors that are offsets, and a sink whose batches stand whole: each with failures in between."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from millrace.sources.polls import PolledFolder, behind, between, moved
from millrace.sources.queues import AcknowledgedQueue, FolderQueue, Pull, QueueReader, settled
from millrace.streaming.delivery import Manifests, delivered, manifest, swept


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    for source in (AcknowledgedQueue, PolledFolder, Manifests):
        spark.dataSource.register(source)


def filled(folder, n, lease=60.0):
    queue = FolderQueue(folder, lease)
    for i in range(n):
        queue.put({"message_id": f"m{i}", "data": f"line {i}", "published_at": f"2024-01-01T00:00:{i % 60:02d}", "attributes": {"k": str(i % 3)}})
    return queue


def counts(queue):
    return tuple(len(os.listdir(f"{queue.folder}/{p}")) for p in ("ready", "leased"))


def drained(query, seconds=90):
    try:
        query.processAllAvailable()
    finally:
        query.stop()
        query.awaitTermination(seconds)


def test_queue_gives_leases_and_takes_back(tmp_path):
    queue = filled(str(tmp_path), 5, lease=0.3)
    a, b = queue.pull(2, 1 << 20), queue.pull(10, 1 << 20)
    assert len(a) == 2 and len(b) == 3 and not queue.waiting() and queue.pull(5, 99) == []
    queue.acknowledge([n for n, _ in b])
    queue.give_back([a[0][0]])
    assert counts(queue) == (1, 1)
    time.sleep(0.4)
    assert {m["message_id"] for _, m in queue.pull(9, 1 << 20)} == {m["message_id"] for _, m in a}
    assert len(filled(f"{tmp_path}/bytes", 9).pull(9, 1)) == 1


def test_a_task_that_runs_again_reads_the_same(tmp_path):
    queue = filled(f"{tmp_path}/q", 6)
    reader = QueueReader(queue, f"{tmp_path}/spool", 2, 2, 1 << 20)
    assert reader.initialOffset() == {"batch": 0} and reader.latestOffset() == {"batch": 1}
    first = list(reader.read(Pull(1, 0)))
    assert len(first) == 2 and list(reader.read(Pull(1, 0))) == first and counts(queue) == (4, 2)
    # two attempts at once: the one that comes second gives back what it pulled
    other = QueueReader(queue, f"{tmp_path}/spool", 2, 2, 1 << 20)
    held, answers = other.spool.held, [None]
    other.spool.held = lambda p: answers.pop() if answers else held(p)
    assert list(other.read(Pull(1, 0))) == first and counts(queue) == (4, 2)
    reader.commit({"batch": 1})
    reader.commit({"batch": 1})
    assert counts(queue) == (4, 0) and reader.latestOffset() == {"batch": 2} and QueueReader(queue, f"{tmp_path}/spool", 1, 1, 1).initialOffset() == {"batch": 1}


def stream(spark, tmp_path, **options):
    reader = spark.readStream.format("acknowledged_queue").option("folder", f"{tmp_path}/q").option("spool", f"{tmp_path}/spool")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_messages_are_acknowledged_after_their_output_stands(spark, tmp_path):
    queue, out = filled(f"{tmp_path}/q", 40), f"{tmp_path}/out"

    def fail(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/{n}")
        assert counts(queue)[1] == 40 - counts(queue)[0] > 0  # leased, not gone
        raise RuntimeError("lost before the batch is reported")

    def write(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/{n}")

    start = lambda f: stream(spark, tmp_path, most=9, pullers=2).writeStream.foreachBatch(f).option("checkpointLocation", f"{tmp_path}/check").start()
    with pytest.raises(Exception, match="lost before"):
        drained(start(fail))
    before = {r.message_id for r in spark.read.parquet(f"{out}/0").collect()}
    assert before and sum(counts(queue)) == 40
    drained(start(write))
    assert {r.message_id for r in spark.read.parquet(f"{out}/0").collect()} == before  # the same batch again
    got = [r.message_id for n in os.listdir(out) for r in spark.read.parquet(f"{out}/{n}").collect()]
    assert sorted(got) == sorted(f"m{i}" for i in range(40))
    settled(f"{tmp_path}/q", f"{tmp_path}/spool")
    assert counts(queue) == (0, 0)
    row = spark.read.parquet(f"{out}/*").where("message_id = 'm7'").first()
    assert (row.data, row.attributes, row.published_at.second) == ("line 7", {"k": "1"}, 7)


def test_cursor():
    start = {"newest": "", "seen": "[]"}
    polls = [[("a", "1", "x"), ("b", "2", "y")], [("b", "2", "y"), ("c", "2", "z"), ("b", "2", "y")], [("c", "2", "z")], [("d", "3", ""), ("a", "1", "x")]]
    got, cursor, ends = [], start, []
    for poll in polls:
        rows = behind(poll, cursor)
        got += rows
        cursor = moved(cursor, rows)
        ends.append(cursor)
    assert [r[0] for r in got] == ["a", "b", "c", "d"] and cursor == {"newest": "3", "seen": '["d"]'} and json.loads(ends[1]["seen"]) == ["b", "c"]
    later = [r for p in polls for r in p] + [("e", "2", "late"), ("f", "4", "")]
    assert [r[0] for r in between(later, start, ends[0])] == ["a", "b"] and [r[0] for r in between(later, ends[0], ends[1])] == ["c"] and between(later, ends[1], ends[2]) == []


def test_polls_give_each_row_once_and_failed_batches_again(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    put = lambda name, rows: (tmp_path / "in" / f"{name}.json").write_text(json.dumps([{"key": k, "at": at, "body": k + at} for k, at in rows]))
    put(1, [("a", "10"), ("b", "10"), ("c", "11")])
    out, failing = f"{tmp_path}/out", [True]

    def write(batch, n):
        batch.write.mode("overwrite").parquet(f"{out}/{n}")
        if failing[0] and n == 1:
            raise RuntimeError("lost in batch 1")

    start = lambda: spark.readStream.format("polled_folder").option("folder", f"{tmp_path}/in").option("most", 3).load().writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/check").start()
    drained(start())
    put(2, [("c", "11"), ("d", "11"), ("e", "12"), ("f", "13"), ("g", "13")])
    with pytest.raises(Exception, match="lost in batch 1"):
        drained(start())
    first = sorted(r.key for r in spark.read.parquet(f"{out}/1").collect())
    put(3, [("g", "13"), ("h", "13"), ("i", "14")])
    failing[0] = False
    drained(start())
    assert sorted(r.key for r in spark.read.parquet(f"{out}/1").collect()) == first
    assert sorted(r.key for r in spark.read.parquet(f"{out}/*").collect()) == list("abcdefghi")


def test_a_batch_stands_whole_or_not_at_all(spark, tmp_path):
    flag, out = f"{tmp_path}/mended", f"{tmp_path}/out"
    spark.range(100).repartition(4).write.parquet(f"{tmp_path}/in")

    @F.udf("long")
    def lost(i):
        if i == 77 and not os.path.exists(flag):
            time.sleep(1)  # the other parts are written by then
            os._exit(1)
        return i

    def start():
        rows = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").select(lost("id").alias("id"))
        return rows.writeStream.format("manifests").option("path", out).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()

    with pytest.raises(Exception):
        start().awaitTermination(120)
    assert delivered(spark, out, "id long").count() == 0 and manifest(spark, out).count() == 0
    open(flag, "w").close()
    start().awaitTermination(120)
    assert sorted(r.id for r in delivered(spark, out, "id long").collect()) == list(range(100))
    assert manifest(spark, out).agg(F.sum("rows")).first()[0] == 100
    left = len(os.listdir(f"{out}/parts")) - manifest(spark, out).count()
    assert swept(spark, out, older=0) == left and delivered(spark, out, "id long").count() == 100


def test_a_batch_is_delivered_once(tmp_path, spark):
    from millrace.streaming.delivery import ManifestWriter, Part

    import pyarrow as pa

    w = ManifestWriter(f"{tmp_path}/out")
    write = lambda *ids: w.write(iter([pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["id"])]))
    w.commit([write(1, 2), None, write(3)], 0)
    w.commit([write(1), write(2, 3)], 0)
    w.abort([write(9)], 1)
    assert w.write(iter([])) == Part("", 0)
    w.commit([w.write(iter([])), None], 1)
    assert sorted(r.id for r in delivered(spark, f"{tmp_path}/out", "id long").collect()) == [1, 2, 3] and len(os.listdir(f"{tmp_path}/out/parts")) == 2
