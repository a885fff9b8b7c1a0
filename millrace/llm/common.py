"""Helpers shared by the corpus operators: words and windows of Arrow text columns, and shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes that separate words: space and \x09 to \x0D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text handled at once inside a task; a longer text is handled on its own.
SLICE_BYTES = 2 << 20

#: Values that one task counts at once.
RUN = 1 << 22

_ODD = (np.random.default_rng(20240229).integers(1, 2**63, 4096, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


#: Folders of applications in local mode that set none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which the driver and all executors see; where it is unset, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _OWN[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts the lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64) - (offsets[0] if len(column) else 0)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with at most limit bytes of text each, or one row."""
    if not batch.num_rows:
        return
    _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def frequent(docs: DataFrame, values: Callable[[pa.RecordBatch], list[np.ndarray]], kinds: int, share: float, least: int, limit: int = SLICE_BYTES, run: int = RUN) -> list[np.ndarray]:
    """For each kind, in rising order, the values that make up share of all values of docs (with __text), least of them at least.

    values gives 64-bit values of each kind for a slice of docs. They are counted in runs of about run, a value where a run holds it
    twice and for half of share at least: at most 2 / share values are found, whatever the size of docs, so that they may be sent to
    every executor. What is found serves to lay rows out, never to decide a result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(kinds)]
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for kind, own in enumerate(held):
                found, n = np.unique(np.concatenate(own), return_counts=True)
                often = n >= max(2, share * n.sum() / 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(often.sum() + 1, kind), pa.int32()), pa.array([None, *found[often].view(np.int64).tolist()], pa.int64()), pa.array(np.append(n.sum(), n[often]), pa.int64())], names=["kind", "value", "n"])
                own.clear()

        for batch in batches:
            for p in slices(batch, "__text", limit):
                for own, found in zip(held, values(p), strict=True):
                    own.append(found)
                    size += len(found)
                if size > run:
                    yield from told()
                    size = 0
        if size:
            yield from told()

    counts = stored(docs.mapInArrow(count, "kind int, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "counts")
    total = {r.kind: r["n"] for r in counts.where("value IS NULL").collect()}
    out = []
    for kind in range(kinds):
        often = counts.where((F.col("kind") == kind) & F.col("value").isNotNull() & (F.col("n") >= max(least, share * total.get(kind, 0)))).select("value").toArrow()
        out.append(np.sort(often.column(0).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
    return out


def among(values: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """Which values are in rising."""
    return rising[np.minimum(np.searchsorted(rising, values), len(rising) - 1)] == values if len(rising) else np.zeros(len(values), dtype=bool)


class Words:
    """The words of each text of a column.

    starts, ends: bytes of each word in data; doc: its row; bounds: n+1 word offsets of the rows. separator: which bytes part words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR):
        self.data, self.offsets = data, offsets
        inside = ~separator[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        self.inside = inside
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.starts)

    def array(self) -> pa.Array:
        """The words as one Arrow array of bytes."""
        ends = np.zeros(len(self) + 1, dtype=np.int32)
        np.cumsum(self.ends - self.starts, out=ends[1:])
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.data[self.inside]))])

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """Numbers of the words within this slice, and the distinct words."""
        coded = self.array().dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(distinct: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte strings, the same in every task."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x, seed) for x in distinct.to_pylist()), dtype=np.uint64, count=len(distinct))


def windows(values: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of width neighbouring values (uint64), len(values)-width+1 of them."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        total += values[j : j + n] * _ODD[(seed * 64 + j) % 4096]
    return mix(total ^ (total >> np.uint64(29)))


def complete(bounds: np.ndarray, total: int, width: int) -> np.ndarray:
    """Which of the total-width+1 windows lie within one row, given the rows' n+1 bounds."""
    n = max(0, total - width + 1)
    keep = np.ones(n, dtype=bool)
    for j in range(1, width):
        cut = bounds[1:-1] - j
        keep[cut[(cut >= 0) & (cut < n)]] = False
    return keep


def covered(total: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of total places lie in a window of the given width that starts at one of starts."""
    change = np.zeros(total + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + width, total), -1)
    return np.cumsum(change[:-1]) > 0


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between the rows' bounds."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
