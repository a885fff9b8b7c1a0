"""Signal stream: deduplicated events folded into issues, counts and samples, one micro-batch at a time.

Each micro-batch adds what it holds: counts are additive, so late events just add to their own minute. Results of a batch are
written below its batch id, so a batch that is retried after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from millrace.functions.text import cut_bytes, resolve_service, scrub, severity_rank
from millrace.operators import issues as I

#: Characters of stored texts at most, frames of a stack, and attributes that name an environment: fixed values.
MAX_TITLE, MAX_MESSAGE, MAX_ATTR, MAX_FRAMES = 512, 8192, 2048, 50
ENVIRONMENTS = ("environment", "env", "deployment.environment", "stage")
#: Severity of an event whose source gave none, by kind: fixed values.
DEFAULT_SEVERITY = {"error": "error", "log_match": "error", "alert": "warning", "security_finding": "warning", "event_bus": "warning"}
DEDUPE_FOR = "10 minutes"
CLOCK_SKEW = "5 minutes"


def prepared(events: DataFrame) -> DataFrame:
    """Events with times as timestamps; one that lies more than CLOCK_SKEW ahead of its arrival takes the time of arrival."""
    received, occurred = F.col("received_at").cast("timestamp"), F.col("occurred_at").cast("timestamp")
    late = occurred.isNull() | (occurred > received + F.expr(f"INTERVAL {CLOCK_SKEW}"))
    return events.withColumn("received_at", received).withColumn("occurred_at", F.when(late, received).otherwise(occurred))


def made_safe(events: DataFrame, rules: list[tuple[str, dict[str, str]]] = ()) -> DataFrame:
    """Prepared events with defaults, secrets scrubbed from every text, bounded texts, environment, service and external id.

    events: as the sources give them. One without a source is no event and left out. An event without an id of its own gets one
    of source, time, title and message, so that a repeat is the same event.
    """
    cut = lambda c, n: cut_bytes(scrub(c if not isinstance(c, str) else F.col(c)), n)
    kinds = F.create_map(*[F.lit(x) for kv in DEFAULT_SEVERITY.items() for x in kv])
    e = prepared(events.where(F.trim(F.coalesce("source", F.lit(""))) != ""))
    e = e.withColumn("kind", F.when(F.col("kind").isin(*DEFAULT_SEVERITY), F.col("kind")).otherwise("error"))
    e = e.withColumn("severity", F.when(severity_rank(F.col("severity")) > 0, F.col("severity")).otherwise(kinds[F.col("kind")]))
    e = e.withColumns({"title": cut(F.trim(F.coalesce("title", F.lit(""))), MAX_TITLE), "message": cut(F.coalesce("message", F.lit("")), MAX_MESSAGE), "exception_type": cut(F.trim(F.coalesce("exception_type", F.lit(""))), MAX_TITLE)})
    e = e.withColumn("attrs", F.transform_values(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda _, v: cut(v, MAX_ATTR)))
    if "stack" in e.columns:
        e = e.withColumn("stack", F.transform(F.slice("stack", 1, MAX_FRAMES), lambda f: f.withField("module", scrub(f["module"])).withField("function", scrub(f["function"])).withField("file", scrub(f["file"]))))
    named = F.coalesce(F.nullif(F.col("environment"), F.lit("")), *(F.nullif(F.col("attrs")[k], F.lit("")) for k in ENVIRONMENTS), F.lit(""))
    first_line = cut_bytes(F.trim(F.split("message", "\n")[0]), MAX_TITLE)
    e = e.withColumns({"title": F.when(F.col("title") != "", F.col("title")).when(F.col("exception_type") != "", F.col("exception_type")).otherwise(first_line), "environment": F.lower(F.trim(named)), "service": resolve_service(F.col("service"), F.col("attrs"), list(rules)), "source": F.lower("source")})
    own = F.concat(F.lit("h:"), F.left(F.sha2(F.concat_ws("\x1f", "source", F.col("occurred_at").cast("string"), "title", "message"), 256), F.lit(32)))
    return e.withColumn("external_id", F.coalesce(F.nullif(F.col("external_id"), F.lit("")), own))


def deduplicated(events: DataFrame) -> DataFrame:
    """Without redeliveries of (connector_id, external_id) within DEDUPE_FOR of arrival."""
    return events.withWatermark("received_at", DEDUPE_FOR).dropDuplicatesWithinWatermark(["connector_id", "external_id"])


def write_batch(batch: DataFrame, batch_id: int, out: str) -> None:
    """A batch's folds, minute counts, first samples and reservoir, below its id."""
    batch = batch.persist()
    try:
        for name, part in (("folds", I.fold(batch)), ("minutes", I.counts(batch, "minute")), ("first", I.first_samples(batch)), ("reservoir", I.reservoir(batch))):
            part.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")
    finally:
        batch.unpersist()


#: Options that bound what one micro-batch of a source takes in: files or offsets. What is beyond waits at the source, nothing is dropped.
BACKLOG = {"files": "maxFilesPerTrigger", "kafka": "maxOffsetsPerTrigger", "rows": "rowsPerSecond"}


def bounded(reader: DataStreamReader, kind: str, most: int) -> DataStreamReader:
    """A stream reader that hands a micro-batch at most most files, offsets or rows a second, so that a slow sink slows the source down."""
    return reader.option(BACKLOG[kind], str(most))


def start(events: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """The stream: events (streaming) to folders below out. trigger: as for writeStream, by default a window a second."""
    stream = deduplicated(prepared(events)).writeStream.foreachBatch(lambda df, n: write_batch(df, n, out)).option("checkpointLocation", checkpoint)
    return stream.trigger(**(trigger or {"processingTime": "1 second"})).start()


def issues_so_far(parts: DataFrame) -> DataFrame:
    """One row per fingerprint from the folds of all batches."""
    return I.merged(parts.drop("batch").limit(0), parts.drop("batch"))


def counts_so_far(parts: DataFrame) -> DataFrame:
    return parts.groupBy("fingerprint", "bucket").agg(F.sum("occurrences").alias("occurrences"), F.sum("suppressed").alias("suppressed"))


def samples_so_far(first: DataFrame, reservoir: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The first samples and the reservoirs of all batches, out of those of each."""
    return I.first_samples(first.drop("n")), I.reservoir(reservoir.drop("slot"), seed)
