"""Which windows of a corpus repeat: the plan shared by the two removers of repeated passages.

1. Every text is cut into segments (see anchors); of each only hashes travel, to meet by anchor.
2. Equal segments are settled there. Segments that share an anchor but differ send their content on, one for each content.
3. These meet by anchor again, and a solver finds the windows that they have in common.
4. What was found goes back to the texts by id, where segments are cut again and marked windows turn into spans.

An anchor may stand in a third of all texts. Anchors and contents that make up a share of all segments are found first: such
contents are counted where they are cut, such anchors' segments meet by content, and their windows, like those of any anchor with
more than SHARD segments, are held against each other by hash in aggregations, not by a solver in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import Segments, Sums, segments
from .common import Words, among, covered, frequent, hashes, mix, slices, stored, utf8

#: Stands for a null id: after all others.
NO_ID = (1 << 63) - 1
REPEATS, OPEN, HASHED = 1, 2, 4
#: An anchor or content with this share of all segments is hot; at most 8192 of each are. Segments of an anchor that a solver takes.
HOT, LEAST, SHARD = 2.0**-12, 1000, 4096
#: Where a segment's row meets others: by anchor, by content (of hot anchors), or counted before (hot contents).
PLAIN, SPREAD, COUNTED = 0, 1, 2
#: Bytes of contents that a solver gets at once, whole anchors at a time.
GATHER = 1 << 20
SLICE = 1 << 20


@dataclass
class Units:
    """Texts as sequences of units: values are units' hashes, bounds the rows' n+1 bounds; starts and ends give the bytes of units."""

    data: np.ndarray
    values: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def words(column: pa.Array) -> Units:
    w = Words(*utf8(column))
    codes, distinct = w.coded()
    return Units(w.data, hashes(distinct)[codes], w.bounds, w.starts, w.ends)


def octets(column: pa.Array) -> Units:
    data, offsets = utf8(column)
    at = np.arange(len(data))
    return Units(data, _BYTE[data], offsets, at, at + 1)


@dataclass(frozen=True)
class Plan:
    units: Callable[[pa.Array], Units]
    width: int
    gram: int
    #: Only earlier ids count (else any other place does, in the same text too).
    earlier: bool
    #: From pieces (anchor, id, units, windows) of whole anchors, by anchor and id, and the width: which windows repeat.
    solve: Callable[[list[tuple[int, int, bytes, int]], int], list[np.ndarray]]

    def cut(self, u: Units) -> Segments:
        return segments(u.values, u.bounds, self.width, self.gram)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def hot(docs: DataFrame, plan: Plan) -> list[np.ndarray]:
    """Anchors and contents of segments that make up a share of all."""

    def values(part: pa.RecordBatch) -> list[np.ndarray]:
        s = plan.cut(plan.units(part.column(1)))
        return [s.anchor, s.content]

    return frequent(docs.select("key", "__text"), values, 2, HOT, LEAST, SLICE, 1 << 20)


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal entries together, and where each group begins in it."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    return order, np.flatnonzero(new)


def marks(docs: DataFrame, plan: Plan) -> DataFrame:
    """key, content, state and way of the segments that repeat or need a closer look; for hot contents (way COUNTED) their first key and times instead."""
    sent = docs.sparkSession.sparkContext.broadcast(hot(docs, plan))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, contents = sent.value
        for batch in batches:
            for p in slices(batch, "__text", SLICE):
                s = plan.cut(plan.units(p.column(1)))
                key, anchor, content, n = p.column(0).to_numpy()[s.row], s.anchor, s.content, np.ones(len(s.row), dtype=np.int64)
                way = np.where(among(content, contents), COUNTED, np.where(among(anchor, anchors), SPREAD, PLAIN)).astype(np.int8)
                if not plan.earlier and len(key):  # runs of one character make the same segment over and over
                    order, new = grouped(s.row, anchor, content)
                    n = np.diff(np.append(new, len(order)))
                    key, anchor, content, way = (x[order[new]] for x in (key, anchor, content, way))
                if (way == COUNTED).any():
                    pick = np.flatnonzero(way == COUNTED)
                    order, new = grouped(content[pick], key[pick])
                    _, first = grouped(content[pick])
                    total = np.add.reduceat(n[pick[order]], first)
                    rest, own = np.flatnonzero(way != COUNTED), pick[order[first]]
                    key, anchor, content, way, n = (np.concatenate([x[rest], x[own]]) for x in (key, anchor, content, way, n))
                    n[len(rest) :] = total
                shard = np.where(way == PLAIN, anchor, mix(content))
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), signed(shard), signed(content), pa.array(n, pa.int64()), pa.array(way)], names=["key", "shard", "content", "n", "way"])

    found = docs.select("key", "__text").mapInArrow(cut, "key long, shard long, content long, n long, way byte").repartition("shard")
    alike, beside = Window.partitionBy("shard", "content"), Window.partitionBy("shard")
    found = found.select("key", "content", "way", F.min("key").over(alike).alias("first"), F.sum("n").over(alike).alias("times"), (F.min("content").over(beside) != F.max("content").over(beside)).alias("several"), F.count("*").over(beside).alias("rows"))
    repeats = (F.col("key") > F.col("first")) if plan.earlier else F.col("times") > 1
    spread = F.col("way") == SPREAD
    open_ = (F.col("several") | spread) & (F.col("key") == F.col("first"))
    state = F.when(repeats, REPEATS).otherwise(0) + F.when(open_, OPEN).otherwise(0) + F.when(open_ & (spread | (F.col("rows") > SHARD)), HASHED).otherwise(0)
    state = F.when(F.col("way") == COUNTED, 0).otherwise(state)
    return found.select("key", "content", state.cast("tinyint").alias("state"), "way", "first", "times").where((F.col("state") > 0) | (F.col("way") == COUNTED))


Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def counted(rows: DataFrame) -> Counts:
    """Rising hot contents with their first keys and times, of what marks() gives; at most 2 / HOT of them."""
    t = rows.where(F.col("way") == COUNTED).select("content", "first", "times").distinct().toArrow()
    content, first, times = (t.column(i).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
    order = np.argsort(content.view(np.uint64))
    return content.view(np.uint64)[order], first[order], times[order]


def states(part: pa.RecordBatch, at: int, s: Segments, plan: Plan, counts: Counts) -> np.ndarray:
    """The state of each segment of a slice, from its row's marks in column at and the counts of hot contents."""
    out = np.zeros(len(s.row), dtype=np.int8)
    column = part.column(at)
    bounds = np.searchsorted(s.row, np.arange(part.num_rows + 1))
    for i in range(part.num_rows):
        if column[i].is_valid and bounds[i + 1] > bounds[i]:
            v = column[i].values
            content, state = v.field(0).to_numpy(zero_copy_only=False).view(np.uint64), v.field(1).to_numpy(zero_copy_only=False)
            order = np.argsort(content)
            content, state = content[order], state[order]
            own = s.content[bounds[i] : bounds[i + 1]]
            place = np.minimum(np.searchsorted(content, own), len(content) - 1)
            out[bounds[i] : bounds[i + 1]] = np.where(content[place] == own, state[place], 0)
    contents, first, times = counts
    pick = np.flatnonzero(among(s.content, contents))
    if len(pick):
        place, key = np.searchsorted(contents, s.content[pick]), part.column(0).to_numpy()[s.row[pick]]
        repeats = key > first[place] if plan.earlier else times[place] > 1
        out[pick] = np.where(repeats, REPEATS, 0) | np.where(key == first[place], OPEN | HASHED, 0)
    return out


def repeated(docs: DataFrame, plan: Plan, finish: Callable[[Units, np.ndarray, np.ndarray], list[pa.Array]], schema: str, text: str, keep: list[str]) -> DataFrame:
    """The columns of docs in keep and what finish makes of (units, covered units, bounds) for each slice."""
    kept = docs.select(*keep).schema
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.struct(*keep).alias("__keep"), F.col(text).alias("__text"))
    rows = stored(marks(own, plan), "marks")
    counts = own.sparkSession.sparkContext.broadcast(counted(rows))
    marked = rows.where(F.col("state") > 0).groupBy("key").agg(F.collect_list(F.struct("content", "state")).alias("marks"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in slices(batch, "__text", SLICE):
                u = plan.units(p.column(1))
                s = plan.cut(u)
                state = states(p, 2, s, plan, counts.value)
                # a segment that its text has more than once goes once, else its windows would come back once for each pair of them
                order, new = grouped(s.row, s.content)
                one = np.zeros(len(s.row), dtype=bool)
                one[order[new]] = True
                pick = np.flatnonzero(one & (state & OPEN > 0) & (state & HASHED == 0))
                ids = p.column(0).to_numpy()
                raw = u.data.tobytes()
                if plan.units is words:
                    texts = [b" ".join(raw[a:b] for a, b in zip(u.starts[f : f + n].tolist(), u.ends[f : f + n].tolist(), strict=True)) for f, n in zip(s.first[pick].tolist(), (s.count[pick] + plan.width - 1).tolist(), strict=True)]
                else:
                    texts = [raw[f : f + n] for f, n in zip(s.first[pick].tolist(), (s.count[pick] + plan.width - 1).tolist(), strict=True)]
                # of anchors with too many segments each window goes by itself, n is its place in the segment
                many = np.flatnonzero(one & (state & HASHED > 0))
                each = np.repeat(many, s.count[many])
                step = np.arange(len(each)) - np.repeat(np.cumsum(s.count[many]) - s.count[many], s.count[many])
                start = s.first[each] + step
                every = np.concatenate([pick, each])
                window = Sums(u.values, 0)(start, start + plan.width) if len(start) else np.zeros(0, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([signed(s.anchor[every]), pa.array(ids[s.row[every]], pa.int64()), signed(s.content[every]), pa.array(texts + [None] * len(each), pa.binary()), pa.array(np.concatenate([s.count[pick], step]).astype(np.int32)), pa.array([None] * len(pick) + window.view(np.int64).tolist(), pa.int64())], names=["anchor", "key", "content", "units", "n", "window"])

    opened = marked.where(F.exists("marks", lambda m: m["state"].bitwiseAND(OPEN) > 0)).select("key", "marks")
    first = own.sparkSession.createDataFrame([(int(k),) for k in np.unique(counts.value[1])], "key long").withColumn("marks", F.lit(None).cast(opened.schema["marks"].dataType))
    opened = opened.unionByName(first.join(opened, "key", "left_anti"))  # whoever holds a hot content first
    sent = stored(own.join(opened, "key").select("key", "__text", "marks").mapInArrow(send, "anchor long, key long, content long, units binary, n int, window long"), "sent")

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in slices(batch, "__text", SLICE):
                u = plan.units(p.column(1))
                flags = np.zeros(len(u.values), dtype=bool)
                if p.column(2).null_count < p.num_rows or p.column(3).null_count < p.num_rows or len(counts.value[0]):
                    s = plan.cut(u)
                    whole = np.flatnonzero(states(p, 2, s, plan, counts.value) & REPEATS)
                    starts = [np.repeat(s.first[whole], s.count[whole]) + np.arange(s.count[whole].sum()) - np.repeat(np.cumsum(s.count[whole]) - s.count[whole], s.count[whole])]
                    bounds = np.searchsorted(s.row, np.arange(p.num_rows + 1))
                    for i in range(p.num_rows):
                        if p.column(3)[i].is_valid:
                            v = p.column(3)[i].values
                            at = dict(zip(v.field(0).to_numpy(zero_copy_only=False).view(np.uint64).tolist(), v.field(1), strict=True))
                            for j in range(bounds[i], bounds[i + 1]):
                                if (x := at.get(int(s.content[j]))) is not None:
                                    starts.append(s.first[j] + x.values.to_numpy(zero_copy_only=False).astype(np.int64))
                    flags = covered(len(u.values), np.concatenate(starts), plan.width) if len(flags) else flags
                yield pa.RecordBatch.from_arrays([p.column(4).field(k) for k in range(len(keep))] + finish(u, flags, u.bounds), names=[*keep, *[x.split()[0] for x in schema.split(", ")]])

    every = own.join(marked, "key", "left").join(settled(sent, plan), "key", "left").select("key", "__text", "marks", "solved", "__keep")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [schema])
    return every.mapInArrow(end, ddl)


def settled(sent: DataFrame, plan: Plan) -> DataFrame:
    """key and solved (contents, and at: which of their windows repeat, each once) of what repeated() sends."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in gathered(batches):
            found = plan.solve([(r[0], r[1], r[3], r[4]) for r in group], plan.width)
            out = [(r[1], r[2], np.flatnonzero(f)) for r, f in zip(group, found, strict=True) if f.any()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2].astype(np.int32) for x in out], pa.list_(pa.int32()))], names=["key", "content", "at"])

    solved = sent.where("window IS NULL").drop("window").repartition("anchor").sortWithinPartitions("anchor", "key", "content").mapInArrow(solve, "key long, content long, at array<int>")
    single = sent.where("window IS NOT NULL").select("anchor", "window", "key", "content", "n")
    times = single.groupBy("anchor", "window").agg(F.min("key").alias("first"), F.count("*").alias("times")).where("times > 1")
    again = single.join(times, ["anchor", "window"]).where(F.col("key") > F.col("first") if plan.earlier else F.lit(True))
    solved = solved.unionByName(again.groupBy("key", "content").agg(F.collect_set("n").alias("at")))
    return solved.groupBy("key").agg(F.collect_list(F.struct("content", "at")).alias("solved"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows (anchor, key, content, units, n) in lists of whole anchors, of about GATHER bytes."""
    rows, size = [], 0
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > GATHER and rows[-1][0] != r[0]:
                yield rows
                rows, size = [], 0
            rows.append(r)
            size += len(r[3])
    if rows:
        yield rows


def runs(flags: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of flags within rows: first and end unit, and the rows' n+1 bounds in runs."""
    edge = np.zeros(len(flags) + 1, dtype=bool)
    edge[bounds] = True
    before = np.concatenate([[False], flags[:-1]]) & ~edge[:-1]
    after = np.concatenate([flags[1:], [False]]) & ~edge[1:]
    first, end = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
    return first, end, np.searchsorted(first, bounds)


def spans_of(flags: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of flags as array<struct<start, stop>> from each row's start."""
    first, end, at = runs(flags, bounds)
    base = np.repeat(bounds[:-1], np.diff(at))
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays([pa.array((first - base).astype(np.int32)), pa.array((end - base).astype(np.int32))], names=["start", "stop"]))

