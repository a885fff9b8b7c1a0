"""Stages that turn the documents table into training data, one after the other.

Quality rules, one document of each group of similar ones, redaction of personal data, the mix of sources to target weights,
and piece encoding. Each stage takes the documents that the one before has left and returns documents with the same columns;
the last returns encoded documents. All stages take documents with a doc_id, a text and a source, whatever other columns there
are and however they are named; an empty table gives an empty table. Null texts count as empty, which the quality rules reject,
null ids as documents of their own, a null source as a source. Rows that repeat are documents of their own, too, until the
second stage keeps one of each group of similar ones.

This file belongs to the corpus operators of millrace.llm, though it stands at the top of the repository.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.jaccard import NO_ID, linked, with_set_id
from millrace.llm.mixing import mixed_documents
from millrace.llm.pieces import checked_pieces
from millrace.llm.pii import redact
from millrace.llm.quality_rules import quality_rules

#: Ids that are sent to every executor rather than joined by a shuffle of the texts: at most 8 MB of them.
FEW = 1_000_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: the rows as they are. Null and empty texts go, as do texts of fewer than 20 words."""
    judged = quality_rules(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text")), keep=["doc"])
    return judged.where("kept").select("doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: of the smallest id, or without one if no row of the group has an id.

    Where several rows have that id, or none has one, the one with the least set of shingles stays, and of rows with that set
    the least. Rows without words are alike to none: they stay, equal ones with one id once.
    """
    classes = stored(linked(docs), "linked")
    stays = (F.col("key") == F.col("component_id")) & F.coalesce(F.col("set_id") == F.col("chosen"), F.lit(True))
    gone = classes.where(~stays & (F.col("key") != NO_ID)).select(F.col("key").alias("doc_id"))
    twice = classes.where(F.col("key") != NO_ID).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("doc_id"))
    known = docs.where(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) != NO_ID)
    left = known.join(few(gone.unionByName(twice)), "doc_id", "left_anti")
    nameless = docs.where(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == NO_ID)
    if classes.where(F.col("key") == NO_ID).isEmpty() and twice.isEmpty():
        return left
    # an id does not tell these rows apart: their sets do
    again = known.join(few(twice), "doc_id", "left_semi").select(*docs.columns).unionByName(nameless)
    again = with_set_id(again.select(F.struct(*docs.columns).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.col("text").alias("__text")))
    kept = classes.where(stays & F.col("set_id").isNotNull()).select("key", "set_id").distinct().join(few(twice.select(F.col("doc_id").alias("key")).unionByName(spark.range(1).select(F.lit(NO_ID).alias("key")))), "key", "left_semi")
    one = again.join(few(kept), ["key", "set_id"], "left_semi").groupBy("key", "set_id").agg(F.min("doc").alias("doc")).select("doc.*")
    wordless = again.where("set_id IS NULL")
    named = wordless.where(F.col("key") != NO_ID).select("doc.*").dropDuplicates()
    return left.select(*docs.columns).unionByName(one).unionByName(named).unionByName(wordless.where(F.col("key") == NO_ID).select("doc.*"))


def few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= FEW else ids


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; null texts stay null, all rows stay."""
    return counted(redact(docs), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes them: a row for each pass over a source. Texts without words have no row."""
    return counted(mixed_documents(docs), docs)


def counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentation of each document, and the scores of the next best; a null text has none."""
    return checked_pieces(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", one_of_each),
    ("PII", personal_data),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]
#: No SQL: compression ratios, boosted trees, permutations and N-best segmentations have none. See tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
