"""Usage queries over the events table, which stands in for the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import usage
from millrace.session import table


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """events as ledger rows: the event type is the feature, the value its cost, k of the props its tokens."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").select(
        F.col("ts").alias("at"), F.col("event_type").alias("feature"), F.col("user_id"), k.alias("input_tokens"), (k % 7).alias("output_tokens"), (k % 5).alias("cache_read_tokens"),
        F.round(F.col("value"), 2).cast("decimal(14,6)").alias("cost_usd"), (k % 4 == 0).alias("cached"), F.when(F.col("event_type") == "error", "error").when(k % 11 == 0, "blocked").otherwise("ok").alias("outcome"),
    )


LEDGER_SQL = """ledger AS (SELECT ts, event_type AS feature, user_id, k AS input_tokens, k % 7 AS output_tokens, k % 5 AS cache_read_tokens,
  CAST(round(value, 2) AS DECIMAL(14,6)) AS cost_usd, (k % 4 = 0) AS cached, CASE WHEN event_type = 'error' THEN 'error' WHEN k % 11 = 0 THEN 'blocked' ELSE 'ok' END AS outcome
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def usage_series(spark: SparkSession, folder: str) -> DataFrame:
    out = usage.usage_series(ledger(spark, folder), "feature", "hour")
    return out.withColumn("cost_usd", F.col("cost_usd").cast("double"))


QUERIES = {"usage_series": usage_series}
ORACLES = {
    "usage_series": f"""WITH {LEDGER_SQL} SELECT date_trunc('hour', ts) AS bucket, feature AS key, count(*) AS calls, CAST(sum(input_tokens + output_tokens) AS BIGINT) AS tokens,
  CAST(sum(cost_usd) AS DOUBLE) AS cost_usd, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, count(*) FILTER (WHERE cached) AS cached_calls,
  count(*) FILTER (WHERE outcome = 'blocked') AS blocked_calls FROM ledger GROUP BY 1, 2""",
}
