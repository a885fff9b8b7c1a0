"""Deliveries of every source, made from orders, one each, and read into events; poll cursors, slots, dead sources and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import map_severity
from millrace.functions.versions import dependencies, major_bumps
from millrace.operators import evaluation as E
from millrace.operators import issues as I
from millrace.session import table
from millrace.sources import logs, webhooks


def joined(*parts: str | Column) -> Column:
    """Strings as they are, columns as text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def delivered(spark: SparkSession, folder: str, source: str, body: Column, config: dict[str, str] | None = None) -> DataFrame:
    """Events of one delivery per order, counted by what their source said of them."""
    o = table(spark, folder, "orders")
    none = F.create_map().cast("map<string,string>")
    own = F.create_map(*[F.lit(x) for kv in config.items() for x in kv]) if config else none
    events = webhooks.events(o.select("o_orderkey", F.to_json(body).alias("body"), none.alias("headers"), own.alias("config")), source)
    return events.groupBy("source", "kind", "severity", "service", "environment", "rule_id").agg(F.count("*").alias("events"), F.countDistinct("external_id").alias("ids"), F.min("title").alias("title"))


def o(column: str) -> Column:
    return F.col("o_" + column)


def part_of(column: str, n: int) -> Column:
    return o(column) % n


def sentry_issues(spark, folder):
    """New and reopened issues; others say nothing."""
    action = F.when(o("orderstatus") == "F", "created").when(o("orderstatus") == "O", "unresolved").otherwise("resolved")
    issue = F.struct(o("orderkey").cast("string").alias("id"), F.when(part_of("orderkey", 2) == 0, "fatal").otherwise("debug").alias("level"), joined("Broken ", part_of("custkey", 3)).alias("title"), F.struct(joined("p", part_of("custkey", 3)).alias("slug")).alias("project"), F.lit("2024-01-01T00:00:00Z").alias("lastSeen"))
    return delivered(spark, folder, "sentry", F.struct(action.alias("action"), F.struct(issue.alias("issue")).alias("data")))


def pagerduty_incidents(spark, folder):
    kind = F.when(o("orderstatus") == "F", "incident.triggered").when(o("orderstatus") == "O", "incident.resolved").otherwise("incident.escalated")
    data = F.struct(F.lit("disk full").alias("title"), F.when(part_of("orderkey", 2) == 0, "high").otherwise("low").alias("urgency"), F.when(part_of("orderkey", 10) == 0, F.struct(F.lit("P1").alias("summary"))).alias("priority"), F.struct(joined("s", part_of("custkey", 4)).alias("id"), joined("svc", part_of("custkey", 4)).alias("summary")).alias("service"))
    return delivered(spark, folder, "pagerduty", F.struct(F.struct(joined("e", o("orderkey")).alias("id"), kind.alias("event_type"), F.lit("2024-01-01T00:00:00Z").alias("occurred_at"), data.alias("data")).alias("event")))


def opsgenie_alerts(spark, folder):
    action = F.when(o("orderstatus") == "F", "Create").when(o("orderstatus") == "O", "Close").otherwise("Escalate")
    alert = F.struct(joined("a", o("orderkey")).alias("alertId"), joined("P", part_of("orderkey", 5) + 1).alias("priority"), F.lit("slow").alias("message"), joined("al", part_of("custkey", 3)).alias("alias"), F.array(F.lit("env:prod"), joined("service:svc", part_of("custkey", 3))).alias("tags"))
    return delivered(spark, folder, "opsgenie", F.struct(action.alias("action"), alert.alias("alert")))


def datadog_monitors(spark, folder):
    move = F.when(o("orderstatus") == "F", "Triggered").when(o("orderstatus") == "O", "Recovered").otherwise("Warn")
    body = F.struct(joined("d", o("orderkey")).alias("id"), move.alias("transition"), F.lit("error").alias("alert_type"), joined("m", part_of("custkey", 3)).alias("alert_id"), F.lit("high load").alias("title"), joined("env:stage,service:svc", part_of("custkey", 3)).alias("tags"))
    return delivered(spark, folder, "datadog", body)


def aws_alarms(spark, folder):
    """Alarms, findings by score, and what else the bus carries."""
    kind = F.when(o("orderstatus") == "F", "CloudWatch Alarm State Change").when(o("orderstatus") == "O", "GuardDuty Finding").otherwise("Other Change")
    detail = F.struct(joined("alarm", part_of("custkey", 3)).alias("alarmName"), F.struct(F.when(part_of("orderkey", 2) == 0, "ALARM").otherwise("OK").alias("value")).alias("state"), (part_of("orderkey", 10)).alias("severity"), joined("f", o("orderkey")).alias("id"), joined("type", part_of("custkey", 2)).alias("type"))
    return delivered(spark, folder, "aws", F.struct(joined("i", o("orderkey")).alias("id"), kind.alias("detail-type"), F.lit("my.app").alias("source"), F.lit("2024-01-01T00:00:00Z").alias("time"), detail.alias("detail"))).drop("title")


def gcp_incidents(spark, folder):
    i = F.struct(joined("g", o("orderkey")).alias("incident_id"), F.when(o("orderstatus") == "O", "closed").otherwise("open").alias("state"), F.when(part_of("orderkey", 2) == 0, "CRITICAL").alias("severity"), F.lit("cpu").alias("policy_name"), joined("c", part_of("custkey", 3)).alias("condition_name"), F.struct(F.lit("prod").alias("env")).alias("policy_user_labels"), F.struct(F.struct(F.lit("run").alias("service_name")).alias("labels")).alias("resource"))
    return delivered(spark, folder, "gcp", F.struct(i.alias("incident")))


def wiz_findings(spark, folder):
    status = F.when(o("orderstatus") == "O", "RESOLVED").otherwise("OPEN")
    return delivered(spark, folder, "wiz", F.struct(F.struct(joined("w", o("orderkey")).alias("id"), status.alias("status"), F.when(part_of("orderkey", 2) == 0, "HIGH").otherwise("INFORMATIONAL").alias("severity")).alias("issue"), F.struct(joined("c", part_of("custkey", 2)).alias("id"), F.lit("Open bucket").alias("name")).alias("control"), F.struct(F.lit("b1").alias("name"), F.struct(F.lit("shop").alias("service"), F.lit("prod").alias("env")).alias("tags")).alias("resource")))


def splunk_searches(spark, folder):
    result = F.struct(F.lit("boom").alias("message"), joined(part_of("orderkey", 6) + 1).alias("severity"), joined("svc", part_of("custkey", 3)).alias("service"))
    return delivered(spark, folder, "splunk", F.struct(F.lit("errors").alias("search_name"), joined("sid", o("orderkey")).alias("sid"), F.lit("ops").alias("app"), F.when(o("orderstatus") != "O", result).alias("result")))


def generic_events(spark, folder):
    """Events of a source without a format, under fields of its own."""
    one = lambda n: F.struct(joined("x", o("orderkey"), "-", F.lit(n)).alias("uuid"), F.when(part_of("orderkey", 2) == 0, "panic").otherwise("notice").alias("level"), F.lit("failed").alias("what"), joined("svc", part_of("custkey", 3)).alias("app"))
    return delivered(spark, folder, "generic", F.struct(F.array(one(1), one(2)).alias("items")), {"source_name": " Cron ", "field.title": "what", "kind": "exception"})


def grafana_alerts(spark, folder):
    alert = F.struct(F.when(o("orderstatus") == "O", "resolved").otherwise("firing").alias("status"), joined("f", o("orderkey")).alias("fingerprint"), F.lit("2024-01-01T00:00:00Z").alias("startsAt"), F.struct(joined("u", part_of("custkey", 3)).alias("__alert_rule_uid__"), F.lit("cpu").alias("alertname"), F.lit("page").alias("severity"), F.lit("web").alias("app")).alias("labels"), F.struct(F.lit("too hot").alias("summary")).alias("annotations"))
    return delivered(spark, folder, "grafana", F.struct(F.array(alert).alias("alerts")))


def firehose_lines(spark, folder):
    """Compressed batches of log lines, one for each customer of orders."""
    line = joined(F.when(o("orderstatus") == "F", "ERROR").when(o("orderstatus") == "O", "INFO").otherwise("WARN"), " order ", o("orderkey"))
    e = F.struct(o("orderkey").cast("string").alias("id"), F.lit(1704067200000).alias("timestamp"), line.alias("message"))
    batch = table(spark, folder, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(joined("/aws/lambda/pay-", F.col("o_custkey") % 3).alias("logGroup"), F.lit("s").alias("logStream"), F.collect_list(e).alias("logEvents"))).alias("doc"))
    body = F.to_json(F.struct(F.array(F.struct(F.base64(F.encode("doc", "UTF-8")).alias("data"))).alias("records")))
    return logs.firehose(batch.select(body.alias("body"))).groupBy("service", "severity").agg(F.count("*").alias("lines"), F.countDistinct("external_id").alias("ids"))


def polled_rows(spark, folder):
    """Rows behind a poll cursor, and at its time those not yet seen, by event type."""
    e = table(spark, folder, "events").select(F.col("event_id").cast("string").alias("id"), F.date_trunc("day", "ts").cast("timestamp").alias("at"), "event_type")
    day = e.select(F.sort_array(F.collect_set("at"))[1].alias("d")).first().d
    return logs.new_rows(e, "at", "id", (str(day), ["0", "1", "2"])).groupBy("event_type").agg(F.count("*").alias("rows"))


def poll_cursor(spark, folder):
    """The cursor after a poll: the newest day and the first ids at it."""
    e = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.date_trunc("day", "ts").alias("at"))
    out = logs.next_cursor(e, "at", "id", 5)
    return out.select("newest", F.array_join(F.transform("seen", lambda x: x.cast("string")), ",").alias("seen"))


def sample_slots(spark, folder):
    """Reservoir slots after all writers: the last one's row."""
    li = table(spark, folder, "lineitem")
    rows = li.select(joined(F.col("l_partkey") % 50).alias("fingerprint"), F.to_date("l_shipdate").alias("day"), (F.col("l_suppkey") % 24).alias("hour"), (F.col("l_linenumber") % 3).alias("slot"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_orderkey").alias("event_id"))
    rows = rows.groupBy("fingerprint", "day", "hour", "slot", "seq").agg(F.max("event_id").alias("event_id"))
    return I.latest_slots(rows).groupBy("fingerprint").agg(F.count("*").alias("slots"), F.sum("event_id").alias("events"))


def recent_samples(spark, folder):
    """What a retention of 400 days before a fixed day keeps."""
    e = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    return I.keep_since(e, "o_orderdate", F.lit("1998-08-02 00:00:00").cast("timestamp_ntz"), 400).groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("kept"))


def document_scores(spark, folder):
    """Confidence in documents, with and without the support of their sources."""
    d = table(spark, folder, "documents")
    g, n, s = F.col("doc_id") % 11 / 10.0, F.col("doc_id") % 5 / 4.0, F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 7 / 6.0)
    score = F.when(s.isNull(), E.document_confidence(g, n)).otherwise(E.document_confidence(g, n, s))
    return d.select("doc_id", F.round(score, 9).alias("score"))


def manifest_versions(spark, folder):
    """Dependencies that a manifest names, and those whose major version changes."""
    d = table(spark, folder, "documents")
    v = lambda c: joined('{"dependencies": {"left-pad": "^', c, '.2.0", "@acme/', F.col("lang"), '": "~1.0.', F.col("doc_id") % 3, '"}}')
    old, new = (dependencies(F.lit("web/package.json"), v(F.col("doc_id") % n)) for n in (2, 3))
    return d.select(F.array_join(F.sort_array(F.map_keys(old)), ",").alias("names"), F.array_join(major_bumps(old, new), ",").alias("bumped")).groupBy("names", "bumped").agg(F.count("*").alias("documents"))


def mapped_words(spark, folder):
    """Severities by a source's own words before the general ones."""
    words = table(spark, folder, "orders").select(F.element_at(F.array(*map(F.lit, ["wiz", "splunk", "other"])), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("source"), F.element_at(F.array(*map(F.lit, [" High", "LOW", "p2", "odd"])), (F.col("o_custkey") % 4 + 1).cast("int")).alias("word"))
    return words.groupBy("source", "word", map_severity(F.col("source"), F.col("word"), F.lit("unset")).alias("severity")).agg(F.count("*").alias("orders"))


QUERIES = {f.__name__: f for f in (sentry_issues, pagerduty_incidents, opsgenie_alerts, datadog_monitors, aws_alarms, gcp_incidents, wiz_findings, splunk_searches, generic_events, grafana_alerts, firehose_lines, polled_rows, poll_cursor, sample_slots, recent_samples, document_scores, manifest_versions, mapped_words)}


def _events(source: str, kind: str, severity: str, service: str, environment: str, rule: str, title: str | None, where: str, each: int = 1) -> str:
    named = "" if title is None else f", min({title}) AS title"
    return f"SELECT '{source}' AS source, '{kind}' AS kind, {severity} AS severity, {service} AS service, {environment} AS environment, {rule} AS rule_id, {each} * count(*) AS events, {each} * count(*) AS ids{named} FROM orders WHERE {where} GROUP BY 1, 2, 3, 4, 5, 6"


_EVEN = "o_orderkey % 2 = 0"
ORACLES = {
    "sentry_issues": _events("sentry", "error", f"CASE WHEN {_EVEN} THEN 'critical' ELSE 'info' END", "'p' || (o_custkey % 3)", "''", "''", "'Broken ' || (o_custkey % 3)", "o_orderstatus IN ('F', 'O')"),
    "pagerduty_incidents": _events("pagerduty", "alert", f"CASE WHEN o_orderkey % 10 = 0 THEN 'critical' WHEN {_EVEN} THEN 'error' ELSE 'warning' END", "'svc' || (o_custkey % 4)", "''", "'s' || (o_custkey % 4) || ':disk full'", "'disk full'", "o_orderstatus <> 'O'"),
    "opsgenie_alerts": _events("opsgenie", "alert", "(['critical', 'error', 'warning', 'info', 'info'])[o_orderkey % 5 + 1]", "'svc' || (o_custkey % 3)", "'prod'", "'al' || (o_custkey % 3)", "'slow'", "o_orderstatus <> 'O'"),
    "datadog_monitors": _events("datadog", "alert", "CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'warning' END", "'svc' || (o_custkey % 3)", "'stage'", "'m' || (o_custkey % 3)", "'high load'", "o_orderstatus <> 'O'"),
    "aws_alarms": " UNION ALL ".join((
        _events("cloudwatch", "alert", "'error'", "''", "''", "'alarm' || (o_custkey % 3)", None, f"o_orderstatus = 'F' AND {_EVEN}"),
        _events("guardduty", "security_finding", "CASE WHEN o_orderkey % 10 >= 9 THEN 'critical' WHEN o_orderkey % 10 >= 7 THEN 'error' WHEN o_orderkey % 10 >= 4 THEN 'warning' ELSE 'info' END", "''", "''", "'type' || (o_custkey % 2)", None, "o_orderstatus = 'O'"),
        _events("cloudwatch", "alert", "'warning'", "''", "''", "'my.app:Other Change'", None, "o_orderstatus NOT IN ('F', 'O')"),
    )),
    "gcp_incidents": _events("gcp", "alert", f"CASE WHEN {_EVEN} THEN 'critical' ELSE 'warning' END", "'run'", "'prod'", "'cpu/c' || (o_custkey % 3)", "'cpu'", "o_orderstatus <> 'O'"),
    "wiz_findings": _events("wiz", "security_finding", f"CASE WHEN {_EVEN} THEN 'error' ELSE 'info' END", "'shop'", "'prod'", "'c' || (o_custkey % 2)", "'Open bucket on b1'", "o_orderstatus <> 'O'"),
    "splunk_searches": _events("splunk", "alert", "(['info', 'info', 'warning', 'error', 'critical', 'critical'])[o_orderkey % 6 + 1]", "'svc' || (o_custkey % 3)", "''", "'ops/errors'", "'errors: boom'", "o_orderstatus <> 'O'"),
    "generic_events": _events("cron", "error", f"CASE WHEN {_EVEN} THEN 'critical' ELSE 'warning' END", "'svc' || (o_custkey % 3)", "''", "''", "'failed'", "true", 2),
    "grafana_alerts": _events("grafana", "alert", "'warning'", "'web'", "''", "'u' || (o_custkey % 3)", "'too hot'", "o_orderstatus <> 'O'"),
    "firehose_lines": "SELECT 'pay-' || (o_custkey % 3) AS service, CASE o_orderstatus WHEN 'F' THEN 'error' ELSE 'warning' END AS severity, count(*) AS lines, count(*) AS ids FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1, 2",
    "polled_rows": "WITH e AS (SELECT event_id, date_trunc('day', ts) AS t, event_type FROM events), d AS (SELECT DISTINCT t FROM e ORDER BY t LIMIT 1 OFFSET 1) SELECT event_type, count(*) AS rows FROM e, d WHERE e.t > d.t OR (e.t = d.t AND event_id NOT IN (0, 1, 2)) GROUP BY 1",
    "poll_cursor": "WITH e AS (SELECT event_id AS id, date_trunc('day', ts) AS t FROM events), n AS (SELECT max(t) AS m FROM e) SELECT CAST(m AS TIMESTAMP) AS newest, array_to_string((list_sort(list(DISTINCT id)))[1:5], ',') AS seen FROM e JOIN n ON t = m GROUP BY m",
    "sample_slots": """WITH r AS (SELECT CAST(l_partkey % 50 AS VARCHAR) AS fingerprint, CAST(l_shipdate AS DATE) AS day, l_suppkey % 24 AS hour, l_linenumber % 3 AS slot, l_orderkey * 10 + l_linenumber AS seq, max(l_orderkey) AS event_id FROM lineitem GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, day, hour, slot ORDER BY seq DESC) AS n FROM r) SELECT fingerprint, count(*) AS slots, CAST(sum(event_id) AS BIGINT) AS events FROM n WHERE n = 1 GROUP BY 1""",
    "recent_samples": "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS kept FROM orders WHERE o_orderdate >= TIMESTAMP '1998-08-02' - INTERVAL 400 DAY GROUP BY 1",
    "document_scores": """WITH d AS (SELECT doc_id, doc_id % 11 / CAST(10 AS DOUBLE) AS g, doc_id % 5 / CAST(4 AS DOUBLE) AS n, doc_id % 7 / CAST(6 AS DOUBLE) AS s FROM documents)
SELECT doc_id, round(CASE WHEN doc_id % 3 = 0 THEN CAST(0.4 AS DOUBLE) * g + CAST(0.2 AS DOUBLE) * n + CAST(0.4 AS DOUBLE) * s ELSE CAST(0.65 AS DOUBLE) * g + CAST(0.35 AS DOUBLE) * n END, 9) AS score FROM d""",
    "manifest_versions": "SELECT '@acme/' || lang || ',left-pad' AS names, CASE WHEN doc_id % 2 <> doc_id % 3 THEN 'left-pad' ELSE '' END AS bumped, count(*) AS documents FROM documents GROUP BY 1, 2",
    "mapped_words": """WITH w AS (SELECT (['wiz', 'splunk', 'other'])[o_orderkey % 3 + 1] AS source, ([' High', 'LOW', 'p2', 'odd'])[o_custkey % 4 + 1] AS word FROM orders)
SELECT source, word, CASE WHEN word = ' High' THEN 'error' WHEN word = 'LOW' THEN 'info' WHEN word = 'p2' THEN 'error' ELSE 'unset' END AS severity, count(*) AS orders FROM w GROUP BY 1, 2""",
}
