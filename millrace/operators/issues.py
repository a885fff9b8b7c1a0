"""Issues: events folded by fingerprint, counts by minute and hour, samples, the status of an issue across windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import severity_of, severity_rank

FIRST_SAMPLES, RESERVOIR = 5, 20


def fold(events: DataFrame) -> DataFrame:
    """One row per fingerprint: occurrences, suppressed, first and last seen, highest severity, sorted sources.

    events: fingerprint, occurred_at, severity, source, suppressed. Suppressed events count apart, but move times, severity and sources.
    """
    return events.groupBy("fingerprint").agg(
        F.count_if(~F.col("suppressed")).alias("occurrences"), F.count_if("suppressed").alias("suppressed"), F.min("occurred_at").alias("first_seen"), F.max("occurred_at").alias("last_seen"),
        severity_of(F.max(severity_rank(F.col("severity")))).alias("severity"), F.sort_array(F.collect_set("source")).alias("sources"),
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two folds as one: sums, least and greatest, union of sources."""
    both = old.unionByName(new)
    return both.groupBy("fingerprint").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("suppressed").alias("suppressed"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        severity_of(F.max(severity_rank(F.col("severity")))).alias("severity"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
    )


def counts(events: DataFrame, unit: str) -> DataFrame:
    """Occurrences and suppressed events by fingerprint and event-time bucket."""
    return events.groupBy("fingerprint", F.date_trunc(unit, "occurred_at").cast("timestamp_ntz").alias("bucket")).agg(F.count_if(~F.col("suppressed")).alias("occurrences"), F.count_if("suppressed").alias("suppressed"))


def hourly(minutes: DataFrame) -> DataFrame:
    """Hour counts from minute counts: what is stored by the hour is summed from minutes, not from events."""
    return minutes.groupBy("fingerprint", F.date_trunc("hour", "bucket").cast("timestamp_ntz").alias("bucket")).agg(F.sum("occurrences").alias("occurrences"), F.sum("suppressed").alias("suppressed"))


def sparkline(hours: DataFrame, end: Column, slots: int = 24) -> DataFrame:
    """slots hourly counts per fingerprint, oldest first, zero where there were none; end: the last slot's hour."""
    age = ((F.unix_timestamp(F.date_trunc("hour", end)) - F.unix_timestamp(F.col("bucket").cast("timestamp"))) / 3600).cast("int")
    per = hours.withColumn("age", age).where(F.col("age").between(0, slots - 1)).groupBy("fingerprint").agg(F.map_from_entries(F.collect_list(F.struct("age", "occurrences"))).alias("by_age"))
    return per.select("fingerprint", F.transform(F.sequence(F.lit(slots - 1), F.lit(0)), lambda h: F.coalesce(F.element_at("by_age", h), F.lit(0))).alias("counts"))


def first_samples(events: DataFrame, n: int = FIRST_SAMPLES) -> DataFrame:
    """The first n events of each fingerprint that were not suppressed, by arrival."""
    by_arrival = Window.partitionBy("fingerprint").orderBy("received_at", "event_id")
    return events.where(~F.col("suppressed")).withColumn("n", F.row_number().over(by_arrival)).where(F.col("n") <= n)


def reservoir(events: DataFrame, seed: int = 0, n: int = RESERVOIR) -> DataFrame:
    """n events at random of each fingerprint and hour of arrival: those with the smallest MD5 of seed and id. Mergeable: of two reservoirs the n smallest are the union's."""
    lot = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("event_id").cast("string")))
    by_lot = Window.partitionBy("fingerprint", F.date_trunc("hour", "received_at")).orderBy(lot, "event_id")
    return events.where(~F.col("suppressed")).withColumn("slot", F.row_number().over(by_lot) - 1).where(F.col("slot") < n)


def next_status(status: Column, occurrences: Column, suppressed: Column, decoded: Column) -> Column:
    """Status after a window; status null: the issue is new. The order of the cases decides."""
    return (
        F.when(status.isNull(), F.when((occurrences == 0) & (suppressed > 0), "suppressed").otherwise("new"))
        .when((occurrences > 0) & (status == "resolved"), "regressed")
        .when((occurrences > 0) & (status == "suppressed"), F.when(decoded, "decoded").otherwise("new"))
        .when((occurrences == 0) & (suppressed > 0) & ~status.isin("acknowledged", "resolved"), "suppressed")
        .otherwise(status)
    )


def keep_since(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows that a retention of days keeps."""
    return df.where(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def latest_slots(samples: DataFrame) -> DataFrame:
    """The last writer of each (fingerprint, day, hour, slot)."""
    keys = ["fingerprint", "day", "hour", "slot"]
    return samples.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in samples.columns if c not in keys]), "seq").alias("row")).select(*keys, "row.*")
