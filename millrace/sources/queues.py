"""Messages of a queue as a stream that acknowledges them once the output of their batch stands.

Each batch is a number. Its tasks pull messages, on the executors, and set what they got aside in a spool in a shared folder before they hand
it on: a batch that is run again finds its messages there. When Spark reports a batch as done, its messages are acknowledged and the
spool goes. What was pulled and neither set aside nor acknowledged comes back after its lease, as do messages whose acknowledgement is
lost, so a message may come twice but never goes missing; message ids tell repeats.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "message_id string, published_at timestamp, attributes map<string,string>, data string"
#: Messages, and bytes of them, that one task pulls for a batch; tasks that pull; seconds until what is not acknowledged comes back.
MOST, MOST_BYTES, PULLERS, LEASE = 500, 8 << 20, 2, 60.0


class FolderQueue:
    """A queue in a shared folder, a JSON file for each message: ready to be pulled, or leased until a time in its name."""

    def __init__(self, folder: str, lease: float = LEASE):
        self.folder, self.lease = folder.removeprefix("file://"), lease
        for part in ("ready", "leased"):
            os.makedirs(f"{self.folder}/{part}", exist_ok=True)

    def put(self, message: dict) -> None:
        name = f"{uuid.uuid4().hex}.json"
        write_once(f"{self.folder}/ready/{name}", json.dumps(message))

    def due(self) -> Iterator[str]:
        """Files that can be pulled, oldest first by name."""
        for name in sorted(os.listdir(f"{self.folder}/ready")):
            yield f"ready/{name}"
        for name in sorted(os.listdir(f"{self.folder}/leased")):
            if float(name.split("@")[0]) < time.time():
                yield f"leased/{name}"

    def waiting(self) -> bool:
        return next(self.due(), None) is not None

    def pull(self, most: int, most_bytes: int) -> list[tuple[str, dict]]:
        """Up to most messages with the names under which they are acknowledged; one message at least, whatever its size."""
        out, size = [], 0
        for place in self.due():
            if len(out) == most or size >= most_bytes:
                break
            mine = f"{time.time() + self.lease:017.6f}@{place.split('@')[-1].split('/')[-1]}"
            try:  # whoever renames a file has it
                os.rename(f"{self.folder}/{place}", f"{self.folder}/leased/{mine}")
            except FileNotFoundError:
                continue
            with open(f"{self.folder}/leased/{mine}") as f:
                text = f.read()
            size += len(text)
            out.append((mine, json.loads(text)))
        return out

    def acknowledge(self, names: list[str]) -> None:
        for name in names:
            try:
                os.remove(f"{self.folder}/leased/{name}")
            except FileNotFoundError:
                pass  # its lease was over: it comes again, and is told by its id

    def give_back(self, names: list[str]) -> None:
        for name in names:
            try:
                os.rename(f"{self.folder}/leased/{name}", f"{self.folder}/ready/{name.split('@')[-1]}")
            except FileNotFoundError:
                pass


def write_once(path: str, text: str) -> bool:
    """A whole file or none; False if it was there before, which then stays."""
    own = f"{os.path.dirname(os.path.dirname(path))}/{uuid.uuid4().hex}.tmp"
    with open(own, "w") as f:
        f.write(text)
    try:
        os.link(own, path)
        return True
    except FileExistsError:
        return False
    finally:
        os.remove(own)


@dataclass
class Pull(InputPartition):
    batch: int
    puller: int


class Spool:
    """What tasks have pulled for each batch, until it is acknowledged."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")
        os.makedirs(self.folder, exist_ok=True)

    def batches(self) -> list[int]:
        return sorted(int(n) for n in os.listdir(self.folder) if n.isdigit())

    def done(self) -> int:
        return max((int(n.removeprefix("done-")) for n in os.listdir(self.folder) if n.startswith("done-")), default=0)

    def latest(self) -> int:
        return max([self.done(), *self.batches()])

    def begin(self, batch: int) -> None:
        os.makedirs(f"{self.folder}/{batch}", exist_ok=True)

    def held(self, p: Pull) -> list[tuple[str, dict]] | None:
        try:
            with open(f"{self.folder}/{p.batch}/{p.puller}.json") as f:
                return [tuple(x) for x in json.load(f)]
        except FileNotFoundError:
            return None

    def hold(self, p: Pull, messages: list[tuple[str, dict]]) -> bool:
        self.begin(p.batch)
        return write_once(f"{self.folder}/{p.batch}/{p.puller}.json", json.dumps(messages))

    def finish(self, batch: int, queue: FolderQueue) -> None:
        """Acknowledges all batches up to batch and forgets them; done twice, it does nothing more."""
        for own in [b for b in self.batches() if b <= batch]:
            for name in os.listdir(f"{self.folder}/{own}"):
                queue.acknowledge([x for x, _ in self.held(Pull(own, int(name.split(".")[0]))) or []])
        before = self.done()
        if batch > before:
            open(f"{self.folder}/done-{batch}", "w").close()
            if before:
                os.remove(f"{self.folder}/done-{before}")
        for own in [b for b in self.batches() if b <= batch]:
            for name in os.listdir(f"{self.folder}/{own}"):
                os.remove(f"{self.folder}/{own}/{name}")
            os.rmdir(f"{self.folder}/{own}")


class QueueReader(DataSourceStreamReader):
    def __init__(self, queue: FolderQueue, spool: str, pullers: int, most: int, most_bytes: int):
        self.queue, self.spool, self.pullers, self.most, self.most_bytes = queue, Spool(spool), pullers, most, most_bytes

    def initialOffset(self) -> dict:
        return {"batch": self.spool.done()}

    def latestOffset(self) -> dict:
        """The next batch if messages wait; where none do, the last one, which has no more to read."""
        if self.queue.waiting():
            self.spool.begin(self.spool.latest() + 1)
        return {"batch": self.spool.latest()}

    def partitions(self, start: dict, end: dict) -> list[Pull]:
        return [Pull(b, i) for b in range(start["batch"] + 1, end["batch"] + 1) for i in range(self.pullers)]

    def read(self, partition: Pull) -> Iterator[tuple]:
        from datetime import datetime

        messages = self.spool.held(partition)
        if messages is None:
            messages = self.queue.pull(self.most, self.most_bytes)
            if not self.spool.hold(partition, messages):  # another attempt of this task was first: what it holds counts
                self.queue.give_back([name for name, _ in messages])
                messages = self.spool.held(partition) or []
        for _, m in messages:
            at = m.get("published_at")
            yield m.get("message_id"), datetime.fromisoformat(at) if at else None, m.get("attributes") or {}, m.get("data")

    def commit(self, end: dict) -> None:
        self.spool.finish(end["batch"], self.queue)


class AcknowledgedQueue(DataSource):
    """spark.dataSource.register(AcknowledgedQueue), then readStream.format("acknowledged_queue").

    Options: folder of the queue, spool (a shared folder of this stream alone), pullers, most, most_bytes, lease. A queue of another kind is a
    subclass with its own queue(), which has waiting, pull, acknowledge and give_back as FolderQueue has.
    """

    @classmethod
    def name(cls) -> str:
        return "acknowledged_queue"

    def schema(self) -> str:
        return SCHEMA

    def queue(self) -> FolderQueue:
        return FolderQueue(self.options["folder"], float(self.options.get("lease", LEASE)))

    def streamReader(self, schema: StructType) -> QueueReader:
        o = self.options
        return QueueReader(self.queue(), o["spool"], int(o.get("pullers", PULLERS)), int(o.get("most", MOST)), int(o.get("most_bytes", MOST_BYTES)))


def settled(folder: str, spool: str, batch: int | None = None) -> None:
    """Acknowledges the batches up to batch (by default all) of a stream that has ended and whose output stands.

    Spark reports a batch as done when it begins the next one; the last batch of a stream that stops is reported when the stream goes on, or here.
    """
    s = Spool(spool)
    s.finish(s.latest() if batch is None else batch, FolderQueue(folder))
