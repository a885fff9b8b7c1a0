"""Issues from events: the fingerprint is the event type and a user group, the severity comes from the payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import issues as I
from millrace.operators import reports as R
from millrace.session import table

SEVERITY = ["info", "warning", "error", "critical"]


def events(spark: SparkSession, folder: str) -> DataFrame:
    return shaped(table(spark, folder, "events"))


def shaped(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select("event_id", F.concat_ws(":", "event_type", (F.col("user_id") % 40).cast("string")).alias("fingerprint"), F.col("ts").alias("occurred_at"), (F.col("ts") + F.make_dt_interval(secs=(k % 90).cast("decimal(18,6)"))).alias("received_at"), F.element_at(F.array(*map(F.lit, SEVERITY)), (k % 4 + 1).cast("int")).alias("severity"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("source"), (k % 13 == 0).alias("suppressed"))


EVENTS_SQL = """ev AS (SELECT event_id, event_type || ':' || (user_id % 40) AS fingerprint, ts AS occurred_at, ts + to_seconds(k % 90) AS received_at, (['info', 'warning', 'error', 'critical'])[k % 4 + 1] AS severity, k % 4 AS r, 's' || (user_id % 3) AS source, k % 13 = 0 AS suppressed
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("sources", F.array_join("sources", ","))


def issue_fold(spark, folder):
    return flat(I.fold(events(spark, folder)))


def issue_fold_in_parts(spark, folder):
    """The same fold from two halves of the events, merged."""
    e = events(spark, folder)
    return flat(I.merged(I.fold(e.where("event_id % 2 = 0")), I.fold(e.where("event_id % 2 = 1"))))


def minute_counts(spark, folder):
    return I.counts(events(spark, folder), "minute")


def hour_counts(spark, folder):
    return I.hourly(I.counts(events(spark, folder), "minute"))


def sparklines(spark, folder):
    e = events(spark, folder)
    end = e.agg(F.date_trunc("hour", F.max("occurred_at")).alias("last"))
    hours = I.hourly(I.counts(e, "minute")).crossJoin(F.broadcast(end))  # one row
    return I.sparkline(hours, F.col("last")).select("fingerprint", F.array_join("counts", ",").alias("counts"))


def first_samples(spark, folder):
    return I.first_samples(events(spark, folder)).select("fingerprint", "event_id", "n")


def reservoir_samples(spark, folder):
    return I.reservoir(events(spark, folder)).select("fingerprint", "event_id", "slot")


def latest_samples(spark, folder):
    return R.latest_row(events(spark, folder).where("not suppressed"), ["fingerprint"], [F.col("received_at").desc(), F.col("event_id")]).select("fingerprint", "event_id", "received_at")


def next_statuses(spark, folder):
    """Status of each issue after a window, from an earlier status made of its counts."""
    f = I.fold(events(spark, folder))
    old = F.element_at(F.array(*map(F.lit, ["new", "resolved", "suppressed", "acknowledged", "decoded"])), (F.col("occurrences") % 5 + 1).cast("int"))
    old = F.when(F.col("suppressed") % 6 != 5, old)
    occ = F.when(F.col("occurrences") % 3 == 0, 0).otherwise(F.col("occurrences"))
    return f.select("fingerprint", I.next_status(old, occ, F.col("suppressed"), F.col("occurrences") % 2 == 0).alias("status"))


def retained_minutes(spark, folder):
    m = I.counts(events(spark, folder), "minute")
    return I.keep_since(m, "bucket", F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), 20)


_FOLD = "count(*) FILTER (WHERE NOT suppressed) AS occurrences, count(*) FILTER (WHERE suppressed) AS suppressed, min(occurred_at) AS first_seen, max(occurred_at) AS last_seen, (['info', 'warning', 'error', 'critical'])[max(r) + 1] AS severity, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources"
_COUNTS = "count(*) FILTER (WHERE NOT suppressed) AS occurrences, count(*) FILTER (WHERE suppressed) AS suppressed"
QUERIES = {f.__name__: f for f in (issue_fold, issue_fold_in_parts, minute_counts, hour_counts, sparklines, first_samples, reservoir_samples, latest_samples, next_statuses, retained_minutes)}
ORACLES = {
    "issue_fold": f"WITH {EVENTS_SQL} SELECT fingerprint, {_FOLD} FROM ev GROUP BY 1",
    "issue_fold_in_parts": f"WITH {EVENTS_SQL} SELECT fingerprint, {_FOLD} FROM ev GROUP BY 1",
    "minute_counts": f"WITH {EVENTS_SQL} SELECT fingerprint, date_trunc('minute', occurred_at) AS bucket, {_COUNTS} FROM ev GROUP BY 1, 2",
    "hour_counts": f"WITH {EVENTS_SQL} SELECT fingerprint, date_trunc('hour', occurred_at) AS bucket, {_COUNTS} FROM ev GROUP BY 1, 2",
    "sparklines": f"""WITH {EVENTS_SQL}, last AS (SELECT date_trunc('hour', max(occurred_at)) AS h FROM ev), c AS (SELECT fingerprint, CAST(date_diff('hour', date_trunc('hour', occurred_at), h) AS INT) AS age, count(*) FILTER (WHERE NOT suppressed) AS n FROM ev, last GROUP BY 1, 2),
  f AS (SELECT DISTINCT fingerprint FROM c WHERE age BETWEEN 0 AND 23), g AS (SELECT fingerprint, unnest(range(0, 24)) AS age FROM f) SELECT fingerprint, string_agg(CAST(coalesce(n, 0) AS VARCHAR), ',' ORDER BY age DESC) AS counts FROM g LEFT JOIN c USING (fingerprint, age) GROUP BY 1""",
    "first_samples": f"WITH {EVENTS_SQL} SELECT fingerprint, event_id, row_number() OVER (PARTITION BY fingerprint ORDER BY received_at, event_id) AS n FROM ev WHERE NOT suppressed QUALIFY n <= 5",
    "latest_samples": f"WITH {EVENTS_SQL} SELECT fingerprint, event_id, received_at FROM ev WHERE NOT suppressed QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY received_at DESC, event_id) = 1",
    "next_statuses": f"""WITH {EVENTS_SQL}, f AS (SELECT fingerprint, {_COUNTS} FROM ev GROUP BY 1), s AS (SELECT fingerprint, CASE WHEN suppressed % 6 <> 5 THEN (['new', 'resolved', 'suppressed', 'acknowledged', 'decoded'])[occurrences % 5 + 1] END AS old, CASE WHEN occurrences % 3 = 0 THEN 0 ELSE occurrences END AS occ, suppressed AS supp, occurrences % 2 = 0 AS decoded FROM f)
SELECT fingerprint, CASE WHEN old IS NULL THEN CASE WHEN occ = 0 AND supp > 0 THEN 'suppressed' ELSE 'new' END WHEN occ > 0 AND old = 'resolved' THEN 'regressed' WHEN occ > 0 AND old = 'suppressed' THEN CASE WHEN decoded THEN 'decoded' ELSE 'new' END WHEN occ = 0 AND supp > 0 AND old NOT IN ('acknowledged', 'resolved') THEN 'suppressed' ELSE old END AS status FROM s""",
    "retained_minutes": f"WITH {EVENTS_SQL} SELECT fingerprint, date_trunc('minute', occurred_at) AS bucket, {_COUNTS} FROM ev WHERE date_trunc('minute', occurred_at) >= TIMESTAMP '2024-01-11' GROUP BY 1, 2",
}

ORACLES["reservoir_samples"] = f"""WITH {EVENTS_SQL} SELECT fingerprint, event_id, CAST(row_number() OVER (PARTITION BY fingerprint, date_trunc('hour', received_at) ORDER BY md5('0:' || event_id), event_id) - 1 AS INT) AS slot FROM ev WHERE NOT suppressed QUALIFY slot < 20"""
