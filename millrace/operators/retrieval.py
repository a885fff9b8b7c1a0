"""Hybrid retrieval: vector search, fusion, packing, evidence, caches, confidence."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import estimate_tokens, same_identifiers
from millrace.operators.folds import in_order
from millrace.session import written

FUSED, RRF_K, PER_FILE, BUDGET, ITEM_TOKENS = 20, 60, 3, 16000, 30
#: Queries that every task holds at once; chunks that bound them from the start; pivots, rings of angles to each (to a radian) and chunks of a pack.
QUERY_BLOCK, SAMPLE, PIVOTS, RINGS, PACK = 16_384, 4096, 64, 16, 1024


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def nearest(chunks: DataFrame, queries: DataFrame, k: int, least: float | None = None, met: Accumulator | None = None) -> DataFrame:
    """query_id, id, rank and score: the k chunks nearest by cosine to each query, ties to the smaller id.

    chunks, queries: id, vector (filtered before: a filter after top-k would lose hits). Exact. Chunks are packed by the pivot that they are nearest to and
    their angle to it; a query's angle to the pivot bounds its cosine with all of a pack, and packs that cannot hold one of its k nearest are passed over.
    What a query has to beat is known from the start from a bounded sample of chunks, and grows with what a task finds. Each task tells the k nearest
    of its packs for each query, so what is exchanged grows with queries, not pairs. met, if given, counts the pairs that were compared.
    """
    spark = chunks.sparkSession
    schema = "query_id long, id long, score double"
    n, out = queries.count(), spark.createDataFrame([], schema)
    sample = chunks.select("vector", "id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    if n and len(sample):
        known = unit(sample)
        centres = pivots(known)
        packs, blocks = packed_by_pivot(chunks, centres), max(1, -(-n // QUERY_BLOCK))
        packs = written(packs, "packs") if blocks > 1 else packs
        for block in range(blocks):  # a stated query set against all chunks, in blocks of a size that every task can hold
            asked = queries.select("id", "vector").where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().combine_chunks()
            if not len(asked):
                continue
            q = unit(asked.column(1).combine_chunks())
            floor = best_of(q, known, k)
            floor = np.maximum(floor, least) if least is not None else floor
            sent = spark.sparkContext.broadcast((asked.column(0).to_numpy(), q, np.arccos(np.clip(q @ centres.T, -1, 1)), floor))
            out = out.unionByName(packs.mapInArrow(held_against(sent, k, met), schema))
    if least is not None:
        out = out.where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pivots(x: np.ndarray) -> np.ndarray:
    """Rows of x that lie far from each other: each the farthest from those before."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(PIVOTS, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def best_of(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The cosine of each row of q with its k-th nearest of x; -inf if x has fewer."""
    if len(x) < k:
        return np.full(len(q), -np.inf)
    return np.concatenate([np.partition(q[i : i + 512] @ x.T, len(x) - k, axis=1)[:, len(x) - k] for i in range(0, len(q), 512)])


def packed_by_pivot(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """pivot, low and high (least and greatest angle to it), and chunks: packs of about PACK chunks of one pivot and nearly one angle."""
    kind = chunks.schema["vector"].dataType.simpleString()

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cosines = unit(b.column(1)) @ centres.T if b.num_rows else np.zeros((0, len(centres)))
            pivot = cosines.argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pivot.astype(np.int32)), pa.array(np.arccos(np.clip(cosines[np.arange(len(pivot)), pivot], -1, 1)))], names=["id", "vector", "pivot", "angle"])

    rows = chunks.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(near, f"id long, vector {kind}, pivot int, angle double").withColumn("ring", F.floor(F.col("angle") * RINGS))
    # at most PIVOTS times the rings of half a circle
    sizes = F.broadcast(rows.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / PACK).alias("packs")))
    dealt = rows.join(sizes, ["pivot", "ring"]).withColumn("pack", F.pmod(F.xxhash64("id"), F.col("packs")))
    return dealt.groupBy("pivot", "ring", "pack").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.collect_list(F.struct("id", "vector")).alias("chunks")).select("pivot", "low", "high", "chunks")


def held_against(sent: Broadcast, k: int, met: Accumulator | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, angles, floor = sent.value
        floor, found = floor.copy(), {}
        for b in batches:
            for pivot, low, high, chunks in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3), strict=True):
                apart = np.maximum(0, np.maximum(angles[:, pivot] - high, low - angles[:, pivot]))
                some = np.flatnonzero(np.cos(apart) >= floor - 1e-9)
                x = unit(chunks.values.field(1)) if len(some) else None
                ids = chunks.values.field(0).to_numpy(zero_copy_only=False)
                if met is not None:
                    met.add(len(some) * len(ids))
                for part in np.split(some, range(256, len(some), 256)) if len(some) else ():
                    scores = q[part] @ x.T
                    for at, own in zip(part, scores, strict=True):
                        near = np.flatnonzero(own >= floor[at] - 1e-9)
                        if len(near):
                            found[at], floor[at] = nearer(found.get(at), own[near], ids[near], k, floor[at])
        for at, (scores, ids) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), names[at]), pa.int64()), pa.array(ids, pa.int64()), pa.array(scores)], names=["query_id", "id", "score"])

    return run


def nearer(held: tuple[np.ndarray, np.ndarray] | None, scores: np.ndarray, ids: np.ndarray, k: int, floor: float) -> tuple[tuple[np.ndarray, np.ndarray], float]:
    """The k best of what is held and what comes, ties to the smaller id, and what is to beat from now on."""
    if held is not None:
        scores, ids = np.concatenate([held[0], scores]), np.concatenate([held[1], ids])
    best = np.lexsort((ids, -scores))[:k]
    return (scores[best], ids[best]), max(floor, scores[best[-1]]) if len(best) == k else floor


def unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def fused(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion. lists: query_id, id, rank (from 1). query_id, id, score and the fused rank."""
    scores = lists.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "id")))


OVERVIEW = ("@docs/overview/overview", "@docs/architecture/architecture")


def path_rank(path: Column, source: Column) -> Column:
    """How much a path says about a repository as a whole, 4 to 1; null for nothing."""
    low = F.lower(path)
    entry = (source == "generated_doc") & low.rlike(r"(^|/)(main|index|app|server|cli|cmd)[^/]*\.md$")
    return F.when(path.isin(*OVERVIEW), 4).when(low.rlike("(^|/)readme"), 3).when(low.rlike("(architecture|overview|design|getting[-_]started|introduction)"), 2).when(entry, 1)


def packed(ranked: DataFrame, budget: int = BUDGET, per_file: int = PER_FILE) -> DataFrame:
    """query_id, place and id of the chunks that fit, in rank order. ranked: query_id, rank, id, file, content.

    A chunk that does not fit is skipped, a later one may fit; skipped chunks don't count towards their file's most. That
    depends on what was taken before, so each query is one fold over its candidates, of which only costs travel.
    """

    def begin():
        used, files, place = 0, Counter(), 0

        def step(c: dict) -> list[dict]:
            nonlocal used, place
            if used + c["cost"] > budget or files[c["file"]] >= per_file:
                return []
            used, place = used + c["cost"], place + 1
            files[c["file"]] += 1
            return [{"query_id": c["query_id"], "place": place, "id": c["id"]}]

        return step

    costs = ranked.select("query_id", "rank", "id", "file", (estimate_tokens(F.col("content")) + ITEM_TOKENS).alias("cost")).where(F.col("cost") <= budget)
    kind = ranked.schema["query_id"].dataType.simpleString()
    return in_order(costs, "query_id", ["rank", "id", "file"], begin, f"query_id {kind}, place int, id long")


def expanded(ranked: DataFrame, chunks: DataFrame, edges: DataFrame, first: int = 5, most: int = 10) -> DataFrame:
    """query_id, place and chunk_id of what the best chunks of each query call or are called by.

    Of the first chunks of code by rank that stand for a symbol, the symbols one step away are taken, at most most of them by key, and
    of these the chunks that the query has not yet. ranked: query_id, rank, chunk_id. chunks: chunk_id, key (of its symbol; null where it stands
    for a whole file or is no code). edges: src, dst (keys).
    """
    code = ranked.join(chunks.where("key IS NOT NULL").select("chunk_id", "key"), "chunk_id")
    asked = code.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "chunk_id"))).where(F.col("n") <= first).select("query_id", "key")
    steps = edges.select(F.col("src").alias("key"), F.col("dst").alias("other")).unionByName(edges.select(F.col("dst").alias("key"), F.col("src").alias("other")))
    near = asked.join(steps, "key").select("query_id", F.col("other").alias("key")).distinct().join(asked, ["query_id", "key"], "left_anti")
    few = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("key"))).where(F.col("place") <= most)
    return few.join(chunks.select("key", "chunk_id"), "key").join(ranked.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "place", "chunk_id")


def evidence(scored: DataFrame, at: float = 0.5, fallback: int = 3) -> DataFrame:
    """query_id, id, rank and weak: chunks judged relevant (relevance >= at, scope >= at / 2), best first; if there are none, the fallback best."""
    good = (F.col("relevance") >= at) & (F.col("scope") >= at / 2)
    by_query = Window.partitionBy("query_id")
    order = by_query.orderBy(F.col("relevance").desc(), "position")
    x = scored.withColumn("good", good).withColumn("weak", F.count_if("good").over(by_query) == 0).withColumn("n", F.row_number().over(order)).where(F.col("good") | (F.col("weak") & (F.col("n") <= fallback)))
    return x.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "rank", "weak")


def fresh_answers(answers: DataFrame, chunks: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Cached answers that still hold: young enough, every cited chunk live, nothing in the cited scopes changed since.

    answers: key, created_at, chunk_ids, scopes. chunks: chunk_id, scope, updated_at, deleted_at.
    """
    young = answers.where(F.col("created_at") > now - F.make_interval(days=F.lit(days)))
    cited = young.select("key", F.explode("chunk_ids").alias("chunk_id")).join(chunks.where("deleted_at IS NULL").select("chunk_id").distinct(), "chunk_id")
    cited = cited.groupBy("key").agg(F.countDistinct("chunk_id").alias("live"))
    newest = chunks.groupBy("scope").agg(F.max("updated_at").alias("newest"))
    stale = young.select("key", "created_at", F.explode("scopes").alias("scope")).join(newest, "scope").where("newest > created_at").select("key").distinct()
    live = young.join(cited, "key", "left").where(F.coalesce("live", F.lit(0)) == F.size("chunk_ids")).drop("live")
    return live.join(stale, "key", "left_anti")


def similar_answers(answers: DataFrame, questions: DataFrame, least: float = 0.95, newest: int = 300) -> DataFrame:
    """The cached answer that each question may reuse: best cosine of at least least among the newest of its scope, same names in both; equal similarity goes to the older.

    answers: key, scope_key, question, embedding, created_at. questions: id, scope_key, question, embedding.
    """
    recent = answers.withColumn("n", F.row_number().over(Window.partitionBy("scope_key").orderBy(F.col("created_at").desc(), "key"))).where(F.col("n") <= newest)
    a = recent.select("scope_key", "key", F.col("question").alias("asked"), F.col("embedding").alias("known"), "n")
    met = questions.join(a, "scope_key").withColumn("similarity", cosine(F.col("embedding"), F.col("known"))).where(F.col("similarity") >= least).where(same_identifiers(F.col("question"), F.col("asked")))
    return met.groupBy("id").agg(F.max_by("key", F.struct("similarity", "n")).alias("key"), F.max("similarity").alias("similarity"))


def cited(text: Column, supplied: Column) -> Column:
    """struct<text, numbers>: citations [n] to supplied sources numbered by first use, others dropped."""
    marker = r"\[([0-9]{1,3})\]"
    numbers = F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(marker), F.lit(1)), lambda x: x.cast("int")), lambda n: n.between(1, supplied)))
    between, found = F.split(text, marker, -1), F.transform(F.regexp_extract_all(text, F.lit(marker), F.lit(1)), lambda x: x.cast("int"))
    new = F.transform(found, lambda n: F.when(n.between(1, supplied), F.concat(F.lit("["), F.array_position(numbers, n).cast("string"), F.lit("]"))).otherwise(""))
    body = F.array_join(F.flatten(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    return F.struct(F.trim(body).alias("text"), numbers.alias("numbers"))


def confidence(text: Column, trusts: Column, weak: Column) -> Column:
    """struct<score, label> of an answer from the share of its sentences that cite and the trust of its citations (array<double>); null without citations."""
    plain = F.regexp_replace(text, r"(?s)```.*?```", " ")
    sentences = F.filter(F.regexp_extract_all(plain, F.lit(r"[^.!?\n]+[.!?]?"), F.lit(0)), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= 4)
    total, with_cite = F.size(sentences), F.size(F.filter(sentences, lambda s: s.rlike(r"\[[0-9]{1,3}\]")))
    cover = F.when(total > 0, with_cite / total).otherwise(1.0)
    n = F.size(trusts)
    mean = F.aggregate(trusts, F.lit(0.0), lambda s, t: s + t) / n
    score = 0.45 * cover + 0.55 * (0.7 * mean + 0.3 * F.array_min(trusts)) - F.when(n == 1, 0.05).otherwise(0.0) - F.when(weak, 0.1).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    label = F.when(score >= 0.8, "high").when(score >= 0.6, "medium").otherwise("low")
    return F.when(n > 0, F.struct(F.round(score, 2).alias("score"), label.alias("label")))
