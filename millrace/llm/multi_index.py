"""Nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut into two halves, each quantised by its own codebook; a vector's cell is its pair of centroids. A query
walks the pairs by summed distance with a heap until the cells it has met hold enough vectors, and those cells' entries are
ranked again by the exact cosine of the original vectors. How many are enough is measured on a bounded sample by brute force:
few where vectors lie in clusters, most where they have no structure.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Vectors at most that the codebooks are fitted on; every vector is indexed.
FIT_ROWS = 20_000
#: Vectors of the sample that are searched by brute force to see how far a walk must go, and the part of their neighbours to reach.
TRIALS, REACH = 256, 0.96
#: Vectors in a cell on average.
CELL = 128
#: Queries in a block at most, about, and bytes of all blocks that are sent to every executor; larger query sets are shuffled.
QUERIES, SENT = 512, 32 << 20
#: Entries of a cell that are held against queries at once.
PACK = 2048
SALT = 64
#: Blocks that one row of a pack is to be held against, and queries whose nearest a task keeps before it tells them.
BLOCKS, KEPT = 64, 100_000


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :], 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return distances(x, centres).argmin(1)


def matrix(column: pa.Array | pd.Series, dims: int) -> np.ndarray:
    if isinstance(column, pd.Series):
        return np.frombuffer(b"".join(column), dtype=np.float64).reshape(-1, dims)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dims)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def walk(first: np.ndarray, second: np.ndarray, held: dict[tuple[int, int], int], enough: int) -> list[tuple[int, int]]:
    """Cells that hold vectors, in the order of first[i] + second[j], until they hold enough."""
    rows, cols = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, found, n = [(first[rows[0]] + second[cols[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and n < enough:
        _, i, j = heapq.heappop(heap)
        cell = (int(rows[i]), int(cols[j]))
        if cell in held:
            found.append(cell)
            n += held[cell]
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(rows) and b < len(cols) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (first[rows[a]] + second[cols[b]], a, b))
    return found


def share_needed(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], half: int, k: int) -> float:
    """Part of all vectors that a walk must meet so that REACH of the k nearest are among them, by trial on unit vectors x."""
    q = x[:TRIALS]
    scores = q @ x.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    sums = distances(q[:, :half], books[0])[:, nearest(x[:, :half], books[0])] + distances(q[:, half:], books[1])[:, nearest(x[:, half:], books[1])]
    at = np.take_along_axis(sums, near, 1)
    order = np.sort(sums, axis=1)
    place = np.array([np.searchsorted(o, a, side="right") for o, a in zip(order, at, strict=True)])
    return float(np.quantile(place / len(x), REACH))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has a direction: not null, not empty, no null or non-finite component, not zero. Doubles."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return vectors.where(F.col("vec_id").isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)).select("vec_id", v.alias("embedding"))


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id, dims, vector (bytes of the doubles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero only
            n = np.diff(col.offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, type=pa.int32()), pa.array([values[at[i] : at[i + 1]].tobytes() for i in range(len(n))], type=pa.binary())], names=["vec_id", "dims", "vector"])

    return vectors.mapInArrow(run, "vec_id long, dims int, vector binary")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vector, and the k+1 smallest ids that have it: all that a search for k others can need. In two steps, the first by salted groups, so that no task holds all copies of a vector."""
    for cols in (["dims", "vector", "salt"], ["dims", "vector"]):
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALT)))
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*cols).orderBy("vec_id"))).where(F.col("n") <= k + 1).drop("n")
    return rows.groupBy("dims", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, share: float | None = None, fit_rows: int = FIT_ROWS, codes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest of vectors (vec_id, embedding) found for each row of queries (same columns).

    share: part of the distinct vectors that a query meets before it stops; by default what share_needed() measures.
    A query never finds its own vec_id. Ties go to the smaller id. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do candidates of another length than the query. Repeated ids among vectors count once per
    distinct vector; a repeated id among queries gives its rows once. Fewer than k candidates: all of them. No vectors: no rows.
    """
    entries = packed(usable(vectors)).distinct()
    entries = stored(distinct_vectors(entries, k).withColumn("entry", F.monotonically_increasing_id()), "entries")
    wanted = packed(usable(queries)).distinct()
    sizes = [r[0] for r in entries.select("dims").distinct().collect()]
    out = None
    for dims in sizes:  # one index for each length of vectors, usually one
        part = one_length(entries.where(F.col("dims") == dims), wanted.where(F.col("dims") == dims), dims, k, share, fit_rows, codes)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else entries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def one_length(entries: DataFrame, queries: DataFrame, dims: int, k: int, share: float | None, fit_rows: int, codes: int | None) -> DataFrame:
    total, half = entries.count(), (dims + 1) // 2
    sample = entries.orderBy(F.xxhash64("vector"), "entry").limit(fit_rows).select("vector").toPandas()
    x = unit(matrix(sample["vector"], dims))
    codes = codes or max(1, min(256, round((total / CELL) ** 0.5)))
    books = kmeans(x[:, :half], codes), kmeans(x[:, half:], codes) if half < dims else np.zeros((1, 0))
    enough = math.ceil((share or share_needed(x, books, half, k)) * total)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = unit(matrix(b.column(1), dims)) if b.num_rows else np.zeros((0, dims))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(nearest(v[:, :half], books[0]).astype(np.int32)), pa.array(nearest(v[:, half:], books[1]).astype(np.int32))], names=["entry", "vector", "ids", "i", "j"])

    cells = stored(entries.select("entry", "vector", "ids").mapInArrow(assign, "entry long, vector binary, ids array<long>, i int, j int"), "cells")
    # at most codes * codes rows, 65536: a table of fixed size, whatever the number of vectors
    sizes = cells.groupBy("i", "j").agg(F.count("*").alias("n"))
    held = {(r.i, r.j): r["n"] for r in sizes.collect()}

    # copies of a query ask once; queries that are near in the first half form a block, as they walk alike
    asked = queries.groupBy("vector").agg(F.min("vec_id").alias("query"))
    asked = stored(asked.select(F.col("query").alias("entry"), "vector", F.array("query").alias("ids")).mapInArrow(assign, "query long, vector binary, ids array<long>, i int, j int"), "asked")
    parts = asked.groupBy("i").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    blocks = asked.join(parts, "i").groupBy("i", F.pmod(F.xxhash64("query"), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("query", "vector")).alias("asks"))
    blocks = stored(blocks.select(F.monotonically_increasing_id().alias("block"), "asks"), "blocks")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {cell: n for n, cell in enumerate(held)}
        cell_i, cell_j = (np.array([c[x] for c in held], dtype=np.int32) for x in (0, 1))
        for b in batches:
            for block, asks in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = unit(matrix(asks.values.field(1), dims))
                met = np.zeros((len(v), len(numbers)), dtype=bool)
                for at, (near, far) in enumerate(zip(distances(v[:, :half], books[0]), distances(v[:, half:], books[1]), strict=True)):
                    met[at, [numbers[c] for c in walk(near, far, held, enough)]] = True
                seen = np.flatnonzero(met.any(0))
                for some in np.split(seen, range(4096, len(seen), 4096)):
                    who = [np.flatnonzero(met[:, c]).astype(np.int32) for c in some]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(cell_i[some]), pa.array(cell_j[some]), pa.array(who, pa.list_(pa.int32()))], names=["block", "i", "j", "who"])

    visits = stored(blocks.mapInArrow(visit, "block long, i int, j int, who array<int>"), "visits")
    # entries of a cell in packs of about PACK, each with the blocks that visit the cell, some hundred at a time
    stock = cells.join(F.broadcast(sizes), ["i", "j"]).withColumn("pack", F.pmod(F.xxhash64("entry"), F.ceil(F.col("n") / PACK)))
    stock = stock.groupBy("i", "j", "pack").agg(F.collect_list(F.struct("vector", "ids")).alias("stock"))
    small = asked.count() * dims * 8 <= SENT
    together = BLOCKS if small else 1
    groups = max(1, math.ceil(blocks.count() / together))
    visits = visits.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)) if small else F.col("block")).groupBy("i", "j", "group").agg(F.collect_list(F.struct("block", "who")).alias("visits"))
    context = entries.sparkSession.sparkContext
    # at most SENT bytes of vectors go to every task; more of them travel with the packs that they meet
    sent = context.broadcast({r.block: ([x.query for x in r.asks], [bytes(x.vector) for x in r.asks]) for r in blocks.collect()}) if small else None

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k+1 nearest of all that a task holds for each query, told once, or whenever the task keeps those of many queries."""
        best: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            for at in range(b.num_rows):
                stock = b.column(1)[at].values
                v, lists = matrix(stock.field(0), dims), [x.as_py() for x in stock.field(1)]
                size = np.sqrt((v * v).sum(1))
                for visit in b.column(0)[at]:
                    who = visit["who"].values.to_numpy(zero_copy_only=False)
                    if sent:
                        names, vectors = sent.value[visit["block"].as_py()]
                        names, q = [names[w] for w in who], np.frombuffer(b"".join(vectors[w] for w in who)).reshape(len(who), dims)
                    else:
                        asks = b.column(2)[at].values.take(pa.array(who))
                        names, q = asks.field(0).to_pylist(), matrix(asks.field(1), dims)
                    for query, near in zip(names, ranked(q, v, size, lists, k), strict=True):
                        best[query] = sorted(best[query] + near)[: k + 1] if query in best else near
                if len(best) > KEPT:
                    yield from told(best)
                    best = {}
        yield from told(best)

    def told(best: dict[int, list[tuple[float, int]]]) -> Iterator[pa.RecordBatch]:
        names = list(best)
        for start in range(0, len(names), 4096):
            rows = [(q, x, -c) for q in names[start : start + 4096] for c, x in best[q]]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["query", "vec_id", "score"])

    met = stock.join(visits, ["i", "j"])
    met = met.select("visits", "stock") if small else met.join(blocks, met["group"] == blocks["block"]).select("visits", "stock", "asks")
    # as many tasks as run at once: each tells a query's nearest once, so their number follows the machines and not the vectors
    found = met.coalesce(context.defaultParallelism).mapInArrow(rank, "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("query", "vec_id", "score")
    # every id with a query's vector gets that query's answers but itself
    owners = queries.select("vec_id", "vector").distinct().join(asked.select("vector", "query"), "vector").select(F.col("vec_id").alias("query_id"), "query")
    out = owners.join(found, "query").where(F.col("query_id") != F.col("vec_id"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def ranked(q: np.ndarray, v: np.ndarray, size: np.ndarray, ids: list[list[int]], k: int) -> list[list[tuple[float, int]]]:
    """For each row of q the k+1 nearest ids, as (-score, id), of one pack of entries v of the given sizes."""
    norm = np.sqrt((q * q).sum(1))[:, None] * size[None, :]
    scores = np.clip(q @ v.T / norm, -1, 1)
    first = np.array([x[0] for x in ids])
    out = []
    few = min(k + 1, len(ids))
    for own in scores:
        least = np.partition(own, len(own) - few)[len(own) - few]
        near = np.flatnonzero(own >= least)
        if len(near) > 4 * few:  # many at one score: the smallest first ids suffice
            near = near[np.lexsort((first[near], -own[near]))][: 4 * few]
        out.append(sorted((-float(own[e]), x) for e in near for x in ids[e])[: k + 1])
    return out


def neighbours(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """search() with the rows whose vec_id is divisible by every as queries, against all rows."""
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
