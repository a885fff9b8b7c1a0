"""Deliveries made here in the shapes of each source, and what they must come to."""

import base64
import gzip
import json

import pytest

from millrace.sources import logs, webhooks

SCHEMA = "n int, body string, headers map<string,string>, config map<string,string>"


def run(spark, source, *bodies, headers=None, config=None):
    rows = [(i, json.dumps(b), headers or {}, config or {}) for i, b in enumerate(bodies)]
    return webhooks.events(spark.createDataFrame(rows, SCHEMA), source).orderBy("n", "external_id").collect()


def test_sentry(spark):
    frames = [{"module": "outer", "function": "run", "lineno": 1, "in_app": False}, {"module": "inner", "function": "pay", "filename": "p.py", "lineno": 7, "in_app": True}]
    error = {"data": {"error": {"event_id": "e1", "issue_id": "g1", "level": "fatal", "title": "T", "timestamp": 1700000000.5, "tags": [["service", "shop"], ["environment", "prod"]], "exception": {"values": [{"type": "A", "value": "a"}, {"type": "B", "value": "b", "stacktrace": {"frames": frames}}]}}}}
    issue = {"action": "created", "data": {"issue": {"id": "9", "level": "warning", "title": "I", "lastSeen": "2024-01-01T00:00:00Z", "metadata": {"type": "X", "value": "v"}, "project": {"slug": "web"}}}}
    metric = {"action": "critical", "data": {"metric_alert": {"id": "3", "alert_rule": {"id": "r", "name": "R"}}}}
    a, b, c = run(spark, "sentry", error, issue, metric, issue | {"action": "resolved"}, metric | {"action": "resolved"})
    assert (a.severity, a.exception_type, a.message, a.service, a.environment, a.group_id, a.occurred_at.microsecond) == ("critical", "B", "b", "shop", "prod", "g1", 500000)
    assert [(f.module, f.function, f.in_app) for f in a.stack] == [("inner", "pay", True), ("outer", "run", False)]
    assert (b.external_id, b.service, b.exception_type, b.kind) == ("issue:9:created:2024-01-01T00:00:00Z", "web", "X", "error")
    assert (c.rule_id, c.severity, c.kind) == ("metric_alert:r", "critical", "alert")


@pytest.mark.parametrize("source", ["alertmanager", "grafana"])
def test_alerts(spark, source):
    body = {"commonLabels": {"severity": "critical", "env": "prod"}, "alerts": [{"status": "Firing", "fingerprint": "f", "startsAt": "2024-01-01T00:00:00Z", "labels": {"alertname": "Down", "severity": "warning", "namespace": "ns"}, "annotations": {"summary": "s", "description": "d"}}, {"status": "resolved", "labels": {}}]}
    (a,) = run(spark, source, body, {"alerts": []})
    assert (a.source, a.severity, a.service, a.environment, a.title, a.message, a.rule_id, a.external_id) == (source, "warning", "ns", "prod", "s", "d", "Down", "f@2024-01-01T00:00:00Z")
    assert a.attrs["annotation.summary"] == "s"


def test_incident_sources(spark):
    pd = {"event": {"id": "x", "event_type": "incident.triggered", "data": {"title": "Order 17 failed", "urgency": "high", "priority": {"summary": "P1"}, "service": {"id": "S", "summary": "pay"}}}}
    (a,) = run(spark, "pagerduty", pd, {"event": {"event_type": "incident.resolved", "data": {}}})
    assert (a.severity, a.rule_id, a.service) == ("critical", "S:order <n> failed", "pay")
    og = {"action": "Create", "alert": {"alertId": "1", "message": "m", "priority": "P2", "tags": ["service:cart", "env:dev", "urgent"], "updatedAt": 1700000000000}}
    (b,) = run(spark, "opsgenie", og, og | {"action": "Close"})
    assert (b.severity, b.service, b.environment, b.rule_id, b.attrs["urgent"]) == ("error", "cart", "dev", "m", "true")
    dd = [{"id": "7", "alert_type": "error", "transition": "Triggered", "title": "t", "tags": "service:api,env:prod"}, {"transition": "Recovered"}, {"alert_type": "info"}]
    (c,) = run(spark, "datadog", dd)
    assert (c.external_id, c.severity, c.service, c.environment) == ("7", "error", "api", "prod")
    gc = {"incident": {"state": "open", "incident_id": "i", "policy_name": "P", "condition_name": "C", "severity": "critical", "resource": {"labels": {"service_name": "svc"}}}}
    (d,) = run(spark, "gcp", gc, {"incident": {"state": "closed"}})
    assert (d.rule_id, d.severity, d.service, d.title) == ("P/C", "critical", "svc", "P")


def test_finding_and_search_sources(spark):
    alarm = {"id": "1", "detail-type": "CloudWatch Alarm State Change", "resources": ["arn"], "detail": {"alarmName": "A", "state": {"value": "ALARM", "reason": "r"}}}
    guard = {"id": "2", "detail-type": "GuardDuty Finding", "detail": {"id": "f", "type": "T", "severity": 8.0, "updatedAt": "u", "resource": {"resourceType": "X"}}}
    quiet = {"id": "3", "detail-type": "CloudWatch Alarm State Change", "detail": {"state": {"value": "OK"}}}
    a, b = run(spark, "aws", alarm, guard, quiet)
    assert (a.rule_id, a.kind, a.message) == ("arn", "alert", "r") and (b.severity, b.external_id, b.resource_id, b.source) == ("error", "f:u", "X", "guardduty")
    (w,) = run(spark, "wiz", {"issue": {"id": "w", "severity": "HIGH"}, "control": {"id": "c", "name": "Open"}, "resource": {"name": "db", "id": "r", "tags": {"service": "s"}}}, {"issue": {"id": "v", "status": "RESOLVED"}})
    assert (w.title, w.severity, w.rule_id, w.resource_id, w.service) == ("Open on db", "error", "c", "r", "s")
    (s,) = run(spark, "splunk", {"search_name": "S", "sid": "9", "app": "ap", "result": {"message": "boom\nmore", "severity": "5"}}, {"search_name": "S", "result": {}})
    assert (s.title, s.severity, s.rule_id, s.external_id) == ("S: boom", "critical", "ap/S", "9")
    g = run(spark, "generic", {"events": [{"id": 1, "title": "t", "level": "warn"}, {"id": 2, "error": {"type": "E"}}]}, [], config={"field.service": "meta.svc", "kind": "alert"})
    assert [(x.external_id, x.title, x.severity, x.kind) for x in g] == [("1", "t", "warning", "alert"), ("2", "E", "", "alert")]


def test_log_lines(spark):
    py = 'ERROR x\nTraceback (most recent call last):\n  File "a.py", line 3, in f\n  File "b.py", line 9, in g\nValueError: bad thing'
    java = 'java.lang.IllegalStateException: no\n\tat com.x.Y.run(Y.java:12)\n\tat com.x.Z.go(Z.java:3)'
    node = "TypeError: nope\n    at pay (/app/p.js:10:5)"
    go = "panic: oops\n\ngoroutine 1 [running]:\nmain.work(0x1)\n\t/src/m.go:8"
    line = '{"level":"warn","msg":"hello","error":{"type":"E"}}'
    rows = spark.createDataFrame([(i, m) for i, m in enumerate([py, java, node, go, line, "INFO fine", "plain"])], "n int, message string")
    out = {r.n: r for r in logs.log_events(rows).collect()}
    assert [(out[0].exception_type, out[0].text), [(f.function, f.line) for f in out[0].stack]] == [("ValueError", "bad thing"), [("g", 9), ("f", 3)]]
    assert (out[1].exception_type, out[1].text, out[1].stack[0].module, out[1].stack[1].line) == ("java.lang.IllegalStateException", "no", "com.x.Y", 3)
    assert (out[2].exception_type, out[2].stack[0].function, out[2].stack[0].file) == ("TypeError", "pay", "/app/p.js")
    assert (out[3].exception_type, out[3].severity, out[3].stack[0].module, out[3].stack[0].function) == ("panic", "critical", "main", "work")
    assert (out[4].text, out[4].severity, out[4].exception_type) == ("hello", "warning", "E")
    assert 5 not in out and out[6].severity == "error"


def test_firehose_and_cursor(spark):
    doc = json.dumps({"logGroup": "/aws/lambda/pay", "logStream": "s", "logEvents": [{"id": "1", "timestamp": 1700000000000, "message": "ERROR a"}, {"id": "2", "timestamp": 1700000001000, "message": "INFO b"}]}).encode()
    body = json.dumps({"records": [{"data": base64.b64encode(gzip.compress(doc)).decode()}, {"data": base64.b64encode(doc).decode()}, {"data": "!!"}]})
    out = logs.firehose(spark.createDataFrame([(body,)], "body string")).collect()
    assert [(r.external_id, r.service, r.severity) for r in out] == [("1", "pay", "error")] * 2
    rows = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01', 'a'), (timestamp'2024-01-01', 'b'), (timestamp'2024-01-02', 'c') t(at, id)")
    assert [r.id for r in logs.new_rows(rows, "at", "id", ("2024-01-01 00:00:00", ["a"])).orderBy("id").collect()] == ["b", "c"]
    assert logs.next_cursor(rows, "at", "id").first().seen == ["c"]
