"""A sink in which a batch stands as a whole or not at all: parts are written first, and a manifest that lists them makes them count."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, any that Arrow knows, and the path in it."""
    return fs.FileSystem.from_uri(path)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class ManifestWriter(DataSourceStreamArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        """One part of a batch, under a name of its own: attempts of a task do not meet. An empty part has no file."""
        store, base = place(self.path)
        name, out, rows = f"{uuid.uuid4().hex}.parquet", None, 0
        for batch in iterator:
            if out is None:
                store.create_dir(f"{base}/parts", recursive=True)
                out = pq.ParquetWriter(f"{base}/parts/{name}", batch.schema, filesystem=store)
            out.write_batch(batch)
            rows += batch.num_rows
        if out is None:
            return Part("", 0)
        out.close()
        return Part(name, rows)

    def commit(self, messages: list[Part | None], batchId: int) -> None:
        """The manifest, once: a batch that was delivered before it was reported done is not delivered again."""
        store, base = place(self.path)
        store.create_dir(f"{base}/manifests", recursive=True)
        final = f"{base}/manifests/{batchId:020d}.json"
        if store.get_file_info(final).type != fs.FileType.NotFound:
            return self.abort(messages, batchId)
        own = f"{base}/{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(own) as f:
            f.write(json.dumps({"batch": batchId, "parts": [{"name": m.name, "rows": m.rows} for m in messages if m and m.rows]}).encode())
        store.move(own, final)

    def abort(self, messages: list[Part | None], batchId: int) -> None:
        store, base = place(self.path)
        for m in messages:
            if m and m.rows and store.get_file_info(f"{base}/parts/{m.name}").type != fs.FileType.NotFound:
                store.delete_file(f"{base}/parts/{m.name}")


class Manifests(DataSource):
    """spark.dataSource.register(Manifests), then writeStream.format("manifests").option("path", ...)."""

    @classmethod
    def name(cls) -> str:
        return "manifests"

    def streamWriter(self, schema: StructType, overwrite: bool) -> ManifestWriter:
        return ManifestWriter(self.options["path"])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """batch, name and rows of all parts that count."""
    if not listed(path, "manifests"):
        return spark.createDataFrame([], "batch long, name string, rows long")
    found = spark.read.schema("batch long, parts array<struct<name: string, rows: long>>").json(f"{path}/manifests")
    return found.select("batch", F.inline("parts"))


def delivered(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """All rows of finished batches. The driver lists their files, as it does for any table; it sees no rows."""
    names = [r["name"] for r in manifest(spark, path).select("name").collect()]
    return spark.read.schema(schema).parquet(*[f"{path}/parts/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def listed(path: str, folder: str) -> list[fs.FileInfo]:
    store, base = place(path)
    return [x for x in store.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True)) if x.type == fs.FileType.File]


def swept(spark: SparkSession, path: str, older: float = 86_400.0) -> int:
    """Removes parts that no manifest lists and that are older than so many seconds: what lost tasks left. Returns how many."""
    store, _ = place(path)
    held = {r["name"] for r in manifest(spark, path).select("name").collect()}
    gone = [x for x in listed(path, "parts") if x.base_name not in held and x.mtime_ns / 1e9 < time.time() - older]
    for x in gone:
        store.delete_file(x.path)
    return len(gone)
