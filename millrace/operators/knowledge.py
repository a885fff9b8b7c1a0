"""Knowledge sources as snapshots, and the context that explains an issue. Readings of the sources are input tables; there are no network clients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.retrieval import nearest
from millrace.operators.rules import frame_chunks

#: Code chunks, similar issues and runbooks of an issue's context at most, and the scores they need: fixed values.
CODE, SIMILAR, RUNBOOKS = (8, None), (3, 0.85), (2, 0.75)


def changed(docs: DataFrame, stream: str, cursor: Column | None = None) -> DataFrame:
    """Documents (stream, id, updated_at, ...) of a stream that changed since its cursor, in the order of their change; all without a cursor."""
    own = docs.where(F.col("stream") == stream)
    return (own if cursor is None else own.where(F.col("updated_at") > cursor)).orderBy("updated_at", "id")


def next_cursor(page: DataFrame, cursors: DataFrame) -> DataFrame:
    """stream and cursor after the documents of page: the latest change, never before the old cursor (cursors: stream, cursor)."""
    latest = page.groupBy("stream").agg(F.max("updated_at").alias("latest"))
    return cursors.join(latest, "stream", "full").select("stream", F.greatest("cursor", "latest").alias("cursor"))


def gone(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """stream and id of stored documents that a full list of ids no longer has. A stream without any listed id was not read and loses none."""
    read = listed.select("stream").distinct()
    return stored.select("stream", "id").join(read, "stream", "left_semi").join(listed.select("stream", "id").distinct(), ["stream", "id"], "left_anti")


def labelled(docs: DataFrame, label: str) -> DataFrame:
    """Documents with a label among their labels (array), whatever its case."""
    return docs.where(F.exists("labels", lambda x: F.lower(x) == label.lower()))


def decode_context(issues: DataFrame, frames: DataFrame, chunks: DataFrame) -> DataFrame:
    """issue, part (code, similar, runbook), place and chunk_id of what explains each issue.

    Code is the chunks of its stack frames first, by frame, then the nearest ones, without repeats; similar issues and runbooks
    are the nearest of their source that are near enough. issues: issue, vector. frames: issue, place, file, function.
    chunks: chunk_id (long), source (code, issue_decode, confluence), path, symbol, vector, owner (the issue of a decode).
    """
    code = chunks.where("source = 'code'")
    numbered = frames.withColumn("frame_id", F.struct("issue", "place"))
    exact = frame_chunks(numbered.select("frame_id", "file", "function"), code.select("chunk_id", "path", "symbol")).select("frame_id.issue", "frame_id.place", "chunk_id")
    exact = exact.groupBy("issue", "chunk_id").agg(F.min("place").alias("place")).withColumn("late", F.lit(0))
    asked = issues.select(F.col("issue").alias("id"), "vector")
    near = lambda source, k, least: nearest(chunks.where(F.col("source") == source).select(F.col("chunk_id").alias("id"), "vector"), asked, k, least=least).select(F.col("query_id").alias("issue"), F.col("id").alias("chunk_id"), F.col("rank").alias("place"))
    both = exact.unionByName(near("code", CODE[0], None).withColumn("late", F.lit(1)))
    best = both.groupBy("issue", "chunk_id").agg(F.min(F.struct("late", "place")).alias("at"))
    order = Window.partitionBy("issue").orderBy("at", "chunk_id")
    out = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= CODE[0]).select("issue", F.lit("code").alias("part"), "place", "chunk_id")
    # one more than asked for, as an issue's own decode is left out
    owners = chunks.where("source = 'issue_decode'").select("chunk_id", "owner")
    like = near("issue_decode", SIMILAR[0] + 1, SIMILAR[1]).join(owners, "chunk_id").where(~F.col("owner").eqNullSafe(F.col("issue")))
    like = like.withColumn("place", F.row_number().over(Window.partitionBy("issue").orderBy("place"))).where(F.col("place") <= SIMILAR[0]).select("issue", F.lit("similar").alias("part"), "place", "chunk_id")
    books = near("confluence", *RUNBOOKS).select("issue", F.lit("runbook").alias("part"), "place", "chunk_id")
    return out.unionByName(like).unionByName(books)
