"""Quality classifier: a byte-level convolutional network in numpy, trained here and applied to whole documents.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide over each chunk; each
filter's largest answer in the chunk is kept (max-pooling). The chunks' answers, averaged and maximised over the document,
give one probability by a logistic layer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

CHUNK, STEP, WIDTH, STRIDE, FILTERS, PAD = 512, 448, 8, 4, 32, 256
#: Most labelled documents of either class that are fetched to fit the network, and most bytes of text in all.
TRAIN_ROWS, TRAIN_BYTES = 700, 24 << 20
EPOCHS, RATE, DOCS_A_STEP = 8, 0.004, 24


def byte_codes() -> np.ndarray:
    """Fixed description of each byte (and of padding, all zero): its kind, and a random code that tells bytes apart."""
    b = np.arange(256)
    letter = ((b | 32) >= 97) & ((b | 32) <= 122)
    kinds = [letter & (b >= 97), letter & (b < 97), (b >= 48) & (b <= 57), b == 32, b == 10, (b > 32) & (b < 127) & ~letter & ~((b >= 48) & (b <= 57)), b >= 128]
    random = np.random.default_rng(11).normal(0, 0.5, (256, 5))
    codes = np.zeros((257, len(kinds) + 5), dtype=np.float32)
    codes[:256] = np.column_stack([*kinds, random])
    return codes


CODES = byte_codes()


@dataclass
class Network:
    """filters: (WIDTH * code size, FILTERS); dense: weights of the mean and the maximum over chunks."""

    filters: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: float


def chunked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of the texts as a matrix of bytes, padded, and the first chunk of each text (n+1 bounds); an empty text has one chunk."""
    sizes = np.diff(offsets)
    n = np.maximum(1, -(-np.maximum(sizes - (CHUNK - STEP), 1) // STEP))
    bounds = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(offsets[:-1], n) + (np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)) * STEP
    place = at[:, None] + np.arange(CHUNK)
    outside = place >= np.repeat(offsets[1:], n)[:, None]
    place[outside] = 0
    chunks = data[place].astype(np.int16) if len(data) else np.zeros(place.shape, dtype=np.int16)
    chunks[outside] = PAD
    return chunks, bounds


def unrolled(chunks: np.ndarray) -> np.ndarray:
    """Every window of WIDTH bytes, STRIDE apart, as one row of codes: (chunk, window, WIDTH * code size)."""
    coded = CODES[chunks]
    n, _, e = coded.shape
    s = coded.strides
    view = np.lib.stride_tricks.as_strided(coded, (n, (CHUNK - WIDTH) // STRIDE + 1, WIDTH * e), (s[0], s[1] * STRIDE, s[2]))
    return np.ascontiguousarray(view)


def pooled(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer of each filter in each chunk, at least 0, and its window."""
    n, p, d = windows.shape
    answers = (windows.reshape(-1, d) @ net.filters).reshape(n, p, FILTERS)
    best = answers.argmax(axis=1)
    return np.maximum(np.take_along_axis(answers, best[:, None, :], 1)[:, 0, :] + net.bias, 0), best


def documents(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean and maximum over each document's chunks, side by side."""
    mean = np.add.reduceat(values, bounds[:-1], axis=0) / np.diff(bounds)[:, None]
    return np.concatenate([mean, np.maximum.reduceat(values, bounds[:-1], axis=0)], axis=1)


def probabilities(net: Network, column: pa.Array) -> np.ndarray:
    chunks, bounds = chunked(*utf8(column))
    values = np.concatenate([np.maximum((unrolled(c).reshape(-1, net.filters.shape[0]) @ net.filters).reshape(len(c), -1, FILTERS).max(axis=1) + net.bias, 0) for c in (chunks[i : i + 256] for i in range(0, len(chunks), 256))])
    return 1 / (1 + np.exp(-np.clip(documents(values, bounds) @ net.dense + net.offset, -30, 30).astype(np.float64)))


def fit(texts: list[str], labels: list[int], share: float, seed: int = 5) -> Network:
    """Adam on the logistic loss. share: part of all training labels that is 1; the sample is drawn by class, so the offset is shifted to it."""
    rng = np.random.default_rng(seed)
    d = WIDTH * CODES.shape[1]
    net = Network(rng.normal(0, 1 / np.sqrt(d), (d, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), np.zeros(2 * FILTERS, np.float32), 0.0)
    y = np.array(labels, dtype=np.float32)
    if not len(y) or y.min() == y.max():
        net.offset = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    state = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in ("filters", "bias", "dense")} | {"offset": (0.0, 0.0)}
    step = 0
    raw = [t.encode() for t in texts]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), DOCS_A_STEP):
            own = order[at : at + DOCS_A_STEP]
            part = [raw[i] for i in own]
            chunks, bounds = chunked(np.frombuffer(b"".join(part), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in part])]))
            windows = unrolled(chunks)
            values, best = pooled(net, windows)
            doc = documents(values, bounds)
            p = 1 / (1 + np.exp(-np.clip(doc @ net.dense + net.offset, -30, 30)))
            delta = ((p - y[own]) * weight[own] / len(own)).astype(np.float32)
            n = np.diff(bounds)
            back = np.repeat(delta / n, n)[:, None] * net.dense[:FILTERS]
            most = values == np.repeat(doc[:, FILTERS:], n, axis=0)
            back = (back + most * np.repeat(delta, n)[:, None] * net.dense[FILTERS:]) * (values > 0)
            taken = windows[np.arange(len(chunks))[:, None], best]  # (chunk, filter, d)
            grads = {"filters": np.einsum("nf,nfd->df", back, taken), "bias": back.sum(axis=0), "dense": doc.T @ delta + 1e-4 * net.dense, "offset": float(delta.sum())}
            step += 1
            for k, g in grads.items():
                m, v = state[k]
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                state[k] = (m, v)
                setattr(net, k, getattr(net, k) - RATE * (1 - 0.7 * epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
    net.offset = float(net.offset + np.log((share + 1e-3) / (1 - share + 1e-3)))
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Network:
    """Fits a network on a bounded sample of docs (doc_id, text) with labels (doc_id, label 0 or 1): at most rows documents of
    each class, the first by a hash of the id, and at most size bytes of text. Ids labelled more than once count once, with
    their lowest label; null labels and ids without a document are left out. No labels: every score is 0.5.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    total = known.agg(F.avg("label")).first()[0]
    sample = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
        sample = part if sample is None else sample.unionByName(part)
    found = docs.where(F.octet_length("text") <= size).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    texts, marks, used = [], [], 0
    for row in found.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        used += len(row.text.encode())
        if used > size:
            break
        texts.append(row.text)
        marks.append(row.label)
    return fit(texts, marks, 0.5 if total is None else float(total))


def score(docs: DataFrame, net: Network, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs named in keep, and score: the probability of label 1 for each whole text; null texts count as empty."""
    keep = ["doc_id"] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(probabilities(net, part.column(len(keep))), type=pa.float64())], names=[*keep, "score"])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + ["score double"])
    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, ddl)


def held_out(doc_id: Column) -> Column:
    """Rows that no classifier of this package learns from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_classifier(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs; learned from labels (doc_id, quality) that are not held out.

    Null and empty texts get a score like any other; repeated rows get equal scores; other columns have no influence.
    """
    known = labels.where(~held_out(labels.doc_id)).select("doc_id", F.col("quality").cast("int").alias("label"))
    net = train(docs.select("doc_id", "text"), known, rows)
    out = score(docs, net)
    return out.select("doc_id", held_out(out.doc_id).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
