"""Byte-level BPE: overlapping chunks are cut into pre-tokens in parallel, stitched, and encoded; ids decode to the exact bytes.

A pre-token depends only on the text from its start on, as the pattern looks ahead but never back and takes every character. Two
readings of one text that share a boundary therefore agree from there on. So long texts are cut into chunks of CHUNK characters, each
with OVERLAP characters of the next; every chunk is read from its own start, whether that is a boundary or not; and where a chunk's
reading and that of the chunk before it first share a boundary within the overlap, the text is stitched. Chunks of one text are rows
of their own, read and encoded by whichever task has them.
"""

from __future__ import annotations

import base64
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shared_dir, slices, stored

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of a chunk, and how far it reads into the next one.
CHUNK, OVERLAP = 1 << 15, 1 << 11
#: Characters that the pattern looks at beyond the end of a match, at most.
AHEAD = 3
#: Bytes of text, or ids, handled at once inside a task.
SLICE = 1 << 20


@dataclass
class Coder:
    """Ranks and pattern; what is made of them is made once in each process."""

    key: tuple[str, str]
    ranks: dict[bytes, int]
    encoding: tiktoken.Encoding = field(init=False)
    matcher: regex.Pattern = field(init=False)
    #: The bytes of all ids, one after the other, and where each begins (n+1 places).
    table: tuple[np.ndarray, np.ndarray] = field(init=False)

    def __post_init__(self) -> None:
        self.encoding = tiktoken.Encoding("own", pat_str=self.key[1], mergeable_ranks=self.ranks, special_tokens={})
        self.matcher = regex.compile(self.key[1])
        own = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            own[rank] = token
        self.table = np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum([0, *map(len, own)])

    def boundaries(self, text: str, stop: int, whole: bool) -> list[int]:
        """Ends of pre-tokens before stop, read from the start of text, that no text beyond it can change and that follow a letter or number.

        A boundary behind white space is left out: white space reads on differently where the text ends there. whole: nothing follows text.
        """
        out, sure = [], len(text) if whole else len(text) - AHEAD
        for m in self.matcher.finditer(text):
            end = m.end()
            if end > sure or end >= stop:
                break
            if text[end - 1].isalnum():
                out.append(end)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def encode_runs(self, text: str) -> list[int]:
        """Ids of a text that holds runs beyond what the library's own reader takes: pre-token by pre-token."""
        out: list[int] = []
        for m in self.matcher.finditer(text):
            own = m.group().encode()
            rank = self.ranks.get(own)
            out.extend(self.encoding._encode_single_piece(own) if rank is None else (rank,))
        return out

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, one after the other, and the bounds of the rows, which end after ends ids."""
        data, at = self.table
        if len(ids) and not (0 <= ids.min() and ids.max() < len(at) - 1):
            raise ValueError("ids outside the vocabulary")
        sizes = at[ids + 1] - at[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return data[np.repeat(at[ids] - total[:-1], sizes) + np.arange(total[-1])], total[ends]


def load(path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> tuple[tuple[str, str], dict[bytes, int]]:
    """Pattern and ranks of a file (on each line the base64 of a token's bytes, a space, its rank), which the driver reads; tasks get them from the driver."""
    with open(path, "rb") as lines:
        return (path, pattern), {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_MADE: dict[tuple[str, str], Coder] = {}


def coder(loaded: tuple[tuple[str, str], dict[bytes, int]]) -> Coder:
    if loaded[0] not in _MADE:
        _MADE.clear()
        _MADE[loaded[0]] = Coder(*loaded)
    return _MADE[loaded[0]]


def lists(rows: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), dtype=np.int32, count=ends[-1])))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, text: str = "text", keep: list[str] | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The columns of docs named in keep (doc_id by default), then tokens: the ids of the text, as the tiktoken library gives them.

    One row per row of docs. Null and empty texts have no ids. Rows that repeat are encoded alike, each on its own; null or repeated
    ids don't matter, nor do other columns, whatever their names; a column tokens in keep is refused by Spark when selected. A
    text of at most chunk characters is one chunk. A longer one is cut as the module says; where two of its chunks share no boundary (a
    run of letters or of white space longer than the overlap) it is encoded in one piece, in memory that grows with that text alone.
    """
    if not 0 < overlap <= chunk:
        raise ValueError("the overlap is at least one character and at most a chunk")
    keep = ["doc_id"] if keep is None else keep
    loaded = load(ranks, pattern)
    docs = docs.select(F.struct(*keep).alias("__doc"), F.coalesce(docs[text], F.lit("")).alias("__text"))
    out = T.StructField("tokens", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(loaded)
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                yield pa.RecordBatch.from_arrays([column(part, "__doc"), lists([c.encode(t) for t in column(part, "__text").to_pylist()])], names=["__doc", "tokens"])

    short = docs.where(F.length("__text") <= chunk).mapInArrow(run, T.StructType([*fields(docs, "__doc"), out]))
    long = stitched(docs.where(F.length("__text") > chunk), loaded, chunk, overlap)
    return short.unionByName(long).select("__doc.*", "tokens")


def cut(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of __text: key (of the text), part, whole (nothing follows), __text, and __doc with the first of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, doc in enumerate(column(batch, "__text")):
                t, key = doc.as_py(), uuid.uuid4().hex
                own = column(batch, "__doc").slice(i, 1)
                n = max(1, -(-len(t) // chunk))
                for at in range(0, n, 64):
                    parts = range(at, min(n, at + 64))
                    first = pa.concat_arrays([own, pa.nulls(len(parts) - 1, own.type)]) if not at else pa.nulls(len(parts), own.type)
                    yield pa.RecordBatch.from_arrays([first, pa.array([key] * len(parts)), pa.array(parts, pa.int32()), pa.array([k == n - 1 for k in parts]), pa.array([t[k * chunk : (k + 1) * chunk + overlap] for k in parts], pa.string())], names=["__doc", "key", "part", "whole", "__text"])

    made = T.StructType([T.StructField("__doc", docs.schema["__doc"].dataType, True), T.StructField("key", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("whole", T.BooleanType()), T.StructField("__text", T.StringType())])
    path = shared_dir(docs.sparkSession, "chunks")
    # small row groups: tasks that read share the chunks of one long text
    docs.mapInArrow(run, made).write.option("parquet.block.size", 8 << 20).parquet(path)
    return docs.sparkSession.read.schema(made).parquet(path)


def stitched(docs: DataFrame, loaded: tuple[tuple[str, str], dict[bytes, int]], chunk: int, overlap: int) -> DataFrame:
    """__doc and tokens of long texts. Their chunks travel once, to meet their borders, and their ids once."""
    chunks = cut(docs, chunk, overlap)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the border before a chunk, the boundaries of its own reading behind it; for the one after it, those of the same reading there."""
        c = coder(loaded)
        for batch in batches:
            rows: list[tuple[str, int, list[int] | None, list[int] | None]] = []
            for key, part, whole, t in zip(*(column(batch, n).to_pylist() for n in ("key", "part", "whole", "__text")), strict=True):
                own = c.boundaries(t, min(len(t), chunk + overlap), whole)
                if part:
                    rows.append((key, part, [0, *own[: bisect_left(own, overlap)]], None))
                if not whole:
                    rows.append((key, part + 1, None, [b - chunk for b in own[bisect_left(own, chunk) :]]))
            kinds = (pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["key", "part", "mine", "before"])

    found = chunks.select("key", "part", "whole", "__text").mapInArrow(read, "key string, part int, mine array<int>, before array<int>")
    shared = F.array_min(F.array_intersect(F.first("mine", True), F.first("before", True)))
    borders = stored(found.groupBy("key", "part").agg(shared.alias("at")), "borders")
    apart = borders.groupBy("key").agg(F.bool_or(F.col("at").isNull()).alias("apart"))
    nothing = F.lit(None).cast("int")
    ends = borders.join(apart, "key").select("key", "apart", F.inline(F.array(F.struct(F.col("part"), F.col("at").alias("start"), nothing.alias("stop")), F.struct((F.col("part") - 1).alias("part"), nothing.alias("start"), (F.col("at") + chunk).alias("stop")))))
    ends = ends.groupBy("key", "part").agg(F.first("apart").alias("apart"), F.max("start").alias("start"), F.max("stop").alias("stop"))
    kinds = [T.StructField("__doc", docs.schema["__doc"].dataType, True), T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("__text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of each chunk between its borders; of texts that do not stitch, the chunks' own characters."""
        c = coder(loaded)
        for batch in batches:
            rows = list(zip(*(column(batch, n).to_pylist() for n in ("__text", "apart", "start", "stop")), strict=True))
            made = lists([[] if apart else c.encode(t[a or 0 : b]) for t, apart, a, b in rows])
            yield pa.RecordBatch.from_arrays([*(column(batch, n) for n in ("__doc", "key", "part")), made, pa.array([t[:chunk] if apart else None for t, apart, *_ in rows], pa.string())], names=["__doc", "key", "part", "tokens", "__text"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(loaded)
        for batch in batches:
            own, texts = column(batch, "tokens"), column(batch, "__text")
            for i in range(batch.num_rows):
                tokens = lists([c.encode_runs(texts[i].as_py())]) if texts[i].is_valid else own.slice(i, 1)
                yield pa.RecordBatch.from_arrays([column(batch, "__doc").slice(i, 1), tokens], names=["__doc", "tokens"])

    # one way at all sizes: a small side that is broadcast at first would hide what the join costs later
    parts = chunks.hint("merge").join(ends, ["key", "part"], "left").select("__doc", "key", "part", "__text", "apart", "start", "stop")
    parts = parts.mapInArrow(run, T.StructType([kinds[0], *fields(chunks, "key", "part"), *kinds[1:]]))
    in_order = F.array_sort(F.collect_list(F.struct("part", "tokens", "__text")))
    texts = parts.groupBy("key").agg(F.first("__doc", True).alias("__doc"), in_order.alias("parts"))
    texts = texts.select("__doc", F.flatten("parts.tokens").alias("tokens"), F.when(F.get("parts.__text", 0).isNotNull(), F.array_join("parts.__text", "")).alias("__text"))
    return texts.mapInArrow(finish, T.StructType(kinds[:2]))


def decode(encoded: DataFrame, ranks: str = RANKS, tokens: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """The columns of encoded named in keep (doc_id by default), then packed, the ids as little-endian unsigned 32-bit integers, as files of
    training data hold them, and decoded, their bytes one after the other. Null ids count as none; ids outside the vocabulary are an error."""
    keep = ["doc_id"] if keep is None else keep
    loaded = load(ranks)
    encoded = encoded.select(F.struct(*keep).alias("__doc"), F.col(tokens).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(loaded)
        for batch in batches:
            held = pc.fill_null(pc.list_value_length(column(batch, "__ids")), 0).to_numpy().astype(np.int64).cumsum()
            start = 0
            while start < batch.num_rows:
                stop = max(start + 1, int(np.searchsorted(held, (held[start - 1] if start else 0) + SLICE, side="right")))
                part = batch.slice(start, stop - start)
                ends = np.concatenate([[0], held[start:stop] - (held[start - 1] if start else 0)])
                ids = column(part, "__ids").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                data, bounds = c.decode(ids, ends)
                yield pa.RecordBatch.from_arrays([column(part, "__doc"), packed(ids.astype("<u4").view(np.uint8), 4 * ends), packed(data, bounds)], names=["__doc", "packed", "decoded"])
                start = stop

    kinds = [*fields(encoded, "__doc"), T.StructField("packed", T.BinaryType()), T.StructField("decoded", T.BinaryType())]
    return encoded.mapInArrow(run, T.StructType(kinds)).select("__doc.*", "packed", "decoded")


def packed(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def byte_bpe(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, and digests of the packed ids and of the bytes that they decode to."""
    out = decode(encode(docs.select("doc_id", "text"), ranks), ranks)
    return out.select("doc_id", (F.length("packed") / 4).cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
