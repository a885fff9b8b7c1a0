"""Queries over sources, queue readings and reservations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import spend
from millrace.operators.reports import rolling_p95
from millrace.session import table
from millrace.sources import documents, logs, webhooks
from millrace.streaming import stateful


def page_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as Markdown."""
    page = documents.page_markdown(F.col("html"))
    return table(spark, folder, "pages").select("page_id", page.alias("p")).select("page_id", "p.title", "p.markdown")


def page_chunks(spark, folder):
    chunks = documents.markdown_chunks(page_documents(spark, folder), "markdown", ["page_id"])
    return documents.with_ids(chunks, "page_id", "symbol")


def document_chunks(spark, folder):
    """Whole documents in parts of at most 900 tokens."""
    return documents.markdown_chunks(table(spark, folder, "documents"), "text", ["doc_id"]).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("content")).alias("chars"))


def delivered_alerts(spark, folder):
    """Alerts delivered as JSON, one delivery per order with its lines as alerts."""
    li = table(spark, folder, "lineitem")
    alert = F.struct(F.when(F.col("l_returnflag") == "R", "firing").otherwise("resolved").alias("status"), F.col("l_linenumber").cast("string").alias("fingerprint"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("startsAt"), F.struct(F.concat(F.lit("rule"), (F.col("l_partkey") % 9).cast("string")).alias("alertname"), F.col("l_linestatus").alias("job")).alias("labels"))
    bodies = li.groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(F.lit("critical").alias("severity")).alias("commonLabels"), F.sort_array(F.collect_list(alert)).alias("alerts"))).alias("body"))
    none = F.create_map().cast("map<string,string>")
    events = webhooks.events(bodies.withColumn("headers", none).withColumn("config", none), "alertmanager")
    return events.groupBy("rule_id", "service", "severity").agg(F.count("*").alias("events"), F.countDistinct("l_orderkey").alias("orders"))


def parsed_log_lines(spark, folder):
    """Events as JSON and plain log lines."""
    e = table(spark, folder, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("user_id") % 3 == 0, "WARN").otherwise("INFO")
    line = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(level.alias("level"), F.col("event_type").alias("msg")))).otherwise(F.concat(level, F.lit(" in "), F.col("event_type")))
    return logs.log_events(e.select("event_id", line.alias("message"))).select("event_id", "level", "text", "severity")


def queue_events(spark, folder):
    """Rules over readings: parts as queues, line items as their readings."""
    li = table(spark, folder, "lineitem")
    kind = F.when(F.col("l_partkey") % 3 == 0, "dlq").when(F.col("l_partkey") % 3 == 1, "lag").otherwise("failures")
    readings = li.select(F.col("l_partkey").cast("string").alias("resource"), kind.alias("condition"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("now"), (F.col("l_quantity") * 100).cast("long").alias("backlog"), F.when(F.col("l_quantity") > 45, F.col("l_quantity").cast("long")).otherwise(0).alias("failures"), F.col("l_returnflag").alias("class"))
    readings = readings.repartition("resource")  # the only shuffle of the readings: their groups and the rules need no other
    readings = readings.groupBy(F.lit("k").alias("connector_id"), "resource", "condition", "now").agg(F.max("backlog").alias("backlog"), F.lit(0).cast("long").alias("age"), F.max("failures").alias("failures"), F.sort_array(F.collect_set("class")).alias("classes"), F.lit(True).alias("newest"))
    return stateful.bus_events_batch(readings).groupBy("event", "severity", "error_class").agg(F.count("*").alias("events"), F.sum("amount").alias("amount"))


def dead_letter_growth(spark, folder):
    """Growth of each dead-letter queue from reading to reading; the first reading is a baseline."""
    from pyspark.sql import Window

    li = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("resource"), F.col("l_shipdate").alias("seen")).agg(F.max(F.col("l_quantity") * 100).cast("long").alias("depth"))
    before = F.lag("depth").over(Window.partitionBy("resource").orderBy("seen"))
    return li.withColumn("added", F.col("depth") - before).where("added > 0").select("resource", "seen", "added")


def hourly_baselines(spark, folder):
    """Nearest-rank 95th percentile of the peaks of the 167 completed hours before each hour."""
    e = table(spark, folder, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.max("value").alias("peak"))
    return rolling_p95(e.withColumn("at", (F.unix_timestamp(F.col("hour").cast("timestamp")) / 3600).cast("long")), ["event_type"], "at", "peak").select("event_type", "hour", "p95")


def admitted_calls(spark, folder):
    """Calls in order against a cap per customer, with reservations of those admitted before."""
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").alias("call_id"), F.floor("o_totalprice").cast("long").alias("tokens"))
    return spend.admitted(o, 400_000)


QUERIES = {f.__name__: f for f in (page_documents, page_chunks, document_chunks, delivered_alerts, parsed_log_lines, queue_events, dead_letter_growth, hourly_baselines, admitted_calls)}
ORACLES = {
    "delivered_alerts": "SELECT 'rule' || (l_partkey % 9) AS rule_id, l_linestatus AS service, 'critical' AS severity, count(*) AS events, count(DISTINCT l_orderkey) AS orders FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "parsed_log_lines": """WITH e AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN 'ERROR' WHEN user_id % 3 = 0 THEN 'WARN' ELSE 'INFO' END AS level FROM events)
SELECT event_id, level, CASE WHEN event_id % 2 = 0 THEN event_type ELSE level || ' in ' || event_type END AS text, CASE level WHEN 'ERROR' THEN 'error' ELSE 'warning' END AS severity FROM e WHERE level <> 'INFO'""",
    "dead_letter_growth": "WITH d AS (SELECT l_partkey AS resource, l_shipdate AS seen, CAST(max(l_quantity * 100) AS BIGINT) AS depth FROM lineitem GROUP BY 1, 2), g AS (SELECT resource, seen, depth - lag(depth) OVER (PARTITION BY resource ORDER BY seen) AS added FROM d) SELECT * FROM g WHERE added > 0",
    "hourly_baselines": "WITH p AS (SELECT event_type, date_trunc('hour', ts) AS hour, max(value) AS peak FROM events GROUP BY 1, 2) SELECT a.event_type, a.hour, min(b.p) AS p95 FROM p a LEFT JOIN LATERAL (SELECT quantile_disc(q.peak, 0.95) AS p FROM p q WHERE q.event_type = a.event_type AND q.hour < a.hour AND q.hour >= a.hour - INTERVAL 167 HOUR) b ON true GROUP BY 1, 2",
    "admitted_calls": """WITH RECURSIVE c AS MATERIALIZED (SELECT o_custkey AS key, o_orderkey AS call_id, CAST(floor(o_totalprice) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
  w AS (SELECT key, call_id, n, CAST(0 AS BIGINT) AS used, tokens <= 400000 AS admitted, CASE WHEN tokens <= 400000 THEN tokens ELSE 0 END AS after FROM c WHERE n = 1
    UNION ALL SELECT c.key, c.call_id, c.n, w.after, w.after + c.tokens <= 400000, CASE WHEN w.after + c.tokens <= 400000 THEN w.after + c.tokens ELSE w.after END FROM w JOIN c ON c.key = w.key AND c.n = w.n + 1) SELECT key, call_id, used, admitted FROM w""",
}
