"""Folds whose steps depend on each other: one pass over each key's rows in order, whatever their number."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a fold's result that are handed on at once.
ROWS = 10_000


def in_order(rows: DataFrame, key: str, order: list[str], begin: Callable[[], Callable[[dict], Iterable[dict]]], schema: str) -> DataFrame:
    """What a fold yields over the rows of each key in the given order.

    begin makes the fold of one key: a function that takes a row and gives the result's rows for it. Spark deals rows out by key and
    sorts them; a task holds one key's state and no list of its rows. One key's rows are one task's, as each step needs the one before.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, step, out = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if step is None or row[key] != at:
                    at, step = row[key], begin()
                out += step(row)
            if len(out) >= ROWS:
                yield told(out)
                out = []
        yield told(out)

    def told(out: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], types[n]) for n in names], names=names)

    types = {f.name: f.type for f in rows.sparkSession.createDataFrame([], schema).toArrow().schema}
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
