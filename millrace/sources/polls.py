"""Rows of a service that is asked again and again, as a stream whose offset is the cursor: the newest time seen and the keys seen at it."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "key string, at string, body string"
Row = tuple[str, str, str]


def behind(rows: Iterable[Row], cursor: dict) -> list[Row]:
    """Rows newer than the cursor, or of its time and not yet seen, each key and time once, by time and key."""
    newest, seen = cursor["newest"], set(json.loads(cursor["seen"]))
    found = {(at, key): body for key, at, body in rows if at > newest or at == newest and key not in seen}
    return [(key, at, body) for (at, key), body in sorted(found.items())]


def moved(cursor: dict, rows: list[Row]) -> dict:
    """The cursor behind rows. Keys of one time add up, as later polls may find more of them."""
    if not rows:
        return cursor
    newest = max(at for _, at, _ in rows)
    before = json.loads(cursor["seen"]) if newest == cursor["newest"] else []
    return {"newest": newest, "seen": json.dumps(sorted({*before, *(key for key, at, _ in rows if at == newest)}))}


def between(rows: Iterable[Row], start: dict, end: dict) -> list[Row]:
    """What a poll from start found if it ended at end, whatever has turned up at or behind end since."""
    seen = set(json.loads(end["seen"]))
    return [r for r in behind(rows, start) if r[1] < end["newest"] or r[1] == end["newest"] and r[0] in seen]


class PollReader(SimpleDataSourceStreamReader):
    """One poll is one batch: a service's answer, which the driver asks for and Spark then deals out."""

    def __init__(self, fetch, most: int):
        self.fetch, self.most = fetch, most

    def initialOffset(self) -> dict:
        return {"newest": "", "seen": "[]"}

    def read(self, start: dict) -> tuple[Iterator[Row], dict]:
        """Up to most rows, but always all that are known of the last time among them: the rest waits for the next poll."""
        rows = behind(self.fetch(start["newest"]), start)
        if len(rows) > self.most:
            last = rows[self.most - 1][1]
            rows = [r for r in rows if r[1] <= last]
        return iter(rows), moved(start, rows)

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[Row]:
        return iter(between(self.fetch(start["newest"]), start, end))


class PolledFolder(DataSource):
    """spark.dataSource.register(PolledFolder), then readStream.format("polled_folder"); a service of another kind is a subclass with its own fetch.

    Options: folder, of JSON files with a list of rows (key, at, body; at as text that sorts by time), and most, the rows of a batch. Answers may
    overlap and repeat rows; rows with an older time than one already seen do not count, as for any cursor.
    """

    @classmethod
    def name(cls) -> str:
        return "polled_folder"

    def schema(self) -> str:
        return SCHEMA

    def fetch(self, since: str) -> Iterator[Row]:
        """Rows of time since or later, in any order, repeated or not."""
        folder = self.options["folder"].removeprefix("file://")
        for name in sorted(os.listdir(folder)):
            if name.endswith(".json"):
                with open(f"{folder}/{name}") as f:
                    for r in json.load(f):
                        if r["at"] >= since:
                            yield r["key"], r["at"], r["body"]

    def simpleStreamReader(self, schema: StructType) -> PollReader:
        return PollReader(self.fetch, int(self.options.get("most", 10_000)))
