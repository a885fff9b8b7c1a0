"""Webhook deliveries to normalised events. Each source is a table of JSON paths; Spark reads the fields and explodes the arrays."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let, map_severity, normalize_message

STACK = "array<struct<module:string,function:string,file:string,line:int,in_app:boolean>>"
FIELDS = ("source", "kind", "severity", "service", "environment", "title", "message", "exception_type", "rule_id", "group_id", "external_id", "resource_id", "occurred_at", "stack", "attrs")


def get(doc: Column, *paths: str) -> Column:
    """The first of several dotted paths that holds something."""
    found = [F.nullif(F.get_json_object(doc, "$." + p), F.lit("")) for p in paths]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def scalars(doc: Column, path: str | None = None) -> Column:
    """An object's scalar members as a map; missing objects are empty maps."""
    m = F.from_json(F.get_json_object(doc, "$." + path) if path else doc, "map<string,string>")
    return F.coalesce(F.map_filter(m, lambda _, v: v.isNotNull() & (v != "") & ~v.rlike(r"^[\[{]")), F.create_map().cast("map<string,string>"))


def tags(doc: Column, path: str) -> Column:
    """'k:v' items, as a list or a comma-separated string; an item without a colon is true."""
    raw = F.get_json_object(doc, "$." + path)
    items = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).otherwise(F.split(raw, ","))
    pairs = F.transform(F.filter(items, lambda t: F.trim(t) != ""), lambda t: F.struct(F.trim(F.substring_index(t, ":", 1)).alias("k"), F.when(t.contains(":"), F.trim(F.substr(t, F.instr(t, ":") + 1))).otherwise("true").alias("v")))
    # of equal keys the last one stays: its place is the last among its key's
    last = lambda ps: F.map_from_entries(F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"])))
    return F.coalesce(let(pairs, last), F.create_map().cast("map<string,string>"))


def merged(first: Column, second: Column) -> Column:
    """Both maps; first wins."""
    return F.map_zip_with(first, second, lambda _, a, b: F.coalesce(a, b))


def parsed_time(text: Column) -> Column:
    """RFC 3339 text, or a number in seconds, milliseconds (over 1e11) or nanoseconds (over 1e17)."""
    n = text.try_cast("double")
    micros = F.when(n > 1e17, n / 1e3).when(n > 1e11, n * 1e3).otherwise(n * 1e6)
    return F.when(n.isNotNull(), F.timestamp_micros(micros.cast("long"))).otherwise(F.try_to_timestamp(text))


def pick(attrs: Column, *keys: str) -> Column:
    return F.coalesce(*(F.nullif(attrs[k], F.lit("")) for k in keys)) if len(keys) > 1 else F.nullif(attrs[keys[0]], F.lit(""))


def fields(**columns: Column) -> list[Column]:
    """The fields of an event, empty where columns have none."""
    none = {"stack": F.array().cast(STACK), "attrs": F.create_map().cast("map<string,string>"), "occurred_at": F.lit(None).cast("timestamp")}
    return [F.coalesce(columns[f], none.get(f, F.lit(""))).alias(f) if f in columns and f != "occurred_at" else columns.get(f, none.get(f, F.lit(""))).alias(f) for f in FIELDS]


def event(**columns: Column) -> Column:
    return F.struct(*fields(**columns))


@dataclass
class Each:
    """Events of a delivery that holds many things: an array of these, what the delivery says for all, what is read of a thing (v) once, and the fields of its event from both.

    Things become rows before their events are made of columns, so that only what a query uses is worked out.
    """

    things: Column
    shared: dict[str, Column]
    read: Callable[[Column, dict[str, Column]], dict[str, Column]]
    event: Callable[[Column, dict[str, Column]], list[Column]]


def sentry(body: Column, headers: Column, config: Column) -> Column:
    action, resource = get(body, "action"), F.element_at(headers, "Sentry-Hook-Resource")
    project = F.coalesce(F.nullif(config["service"], F.lit("")), F.lit(None))
    e = F.coalesce(F.get_json_object(body, "$.data.error"), F.get_json_object(body, "$.data.event"))
    raw = F.get_json_object(e, "$.tags")
    listed = F.from_json(raw, "array<array<string>>")
    keyed = F.from_json(raw, "array<struct<key:string,value:string>>")
    tag_map = F.coalesce(
        F.when(raw.rlike(r"^\s*\[\s*\["), F.map_from_entries(F.transform(F.filter(listed, lambda t: F.size(t) == 2), lambda t: F.struct(t[0].alias("key"), t[1].alias("value"))))),
        F.when(raw.rlike(r"^\s*\[\s*\{"), F.map_from_entries(F.filter(keyed, lambda t: t["key"].isNotNull()))), F.create_map().cast("map<string,string>"),
    )
    values = F.from_json(F.get_json_object(e, "$.exception.values"), "array<struct<type:string,value:string,stacktrace:struct<frames:array<struct<module:string,package:string,function:string,filename:string,abs_path:string,lineno:int,in_app:boolean>>>>>")
    last = F.try_element_at(values, F.lit(-1))
    stack = F.transform(F.reverse(last["stacktrace"]["frames"]), lambda f: F.struct(F.coalesce(f["module"], f["package"], F.lit("")).alias("module"), F.coalesce(f["function"], F.lit("")).alias("function"), F.coalesce(f["filename"], f["abs_path"], F.lit("")).alias("file"), F.coalesce(f["lineno"], F.lit(0)).alias("line"), F.coalesce(f["in_app"], F.lit(False)).alias("in_app")))
    error = event(
        source=F.lit("sentry"), kind=F.lit("error"), external_id=get(e, "event_id", "id"), group_id=get(e, "issue_id", "groupID"), occurred_at=parsed_time(get(e, "timestamp", "datetime", "received")), severity=map_severity(F.lit("sentry"), get(e, "level"), F.lit("error")), title=get(e, "title"),
        environment=F.coalesce(get(e, "environment"), tag_map["environment"]), exception_type=last["type"], message=F.coalesce(F.nullif(last["value"], F.lit("")), get(e, "message", "logentry.formatted", "logentry.message", "culprit")), stack=stack,
        service=F.coalesce(F.nullif(tag_map["service"], F.lit("")), project, F.trim(get(e, "project_slug", "project_name"))), attrs=tag_map,
    )
    i = F.get_json_object(body, "$.data.issue")
    issue = event(
        source=F.lit("sentry"), kind=F.lit("error"), group_id=get(i, "id"), external_id=F.concat_ws(":", F.lit("issue"), get(i, "id"), action, F.coalesce(get(i, "lastSeen"), F.lit(""))), occurred_at=parsed_time(get(i, "lastSeen", "firstSeen")), severity=map_severity(F.lit("sentry"), get(i, "level"), F.lit("error")),
        title=get(i, "title"), exception_type=get(i, "metadata.type"), message=get(i, "metadata.value", "culprit"), service=F.coalesce(project, F.trim(get(i, "project.slug"))),
    )
    m = F.get_json_object(body, "$.data.metric_alert")
    metric = event(
        source=F.lit("sentry"), kind=F.lit("alert"), rule_id=F.concat(F.lit("metric_alert:"), get(m, "alert_rule.id", "id")), external_id=F.concat_ws(":", F.lit("metric"), get(m, "id"), action), severity=F.when(action == "critical", "critical").otherwise("warning"), occurred_at=parsed_time(get(m, "date_started", "date_detected")),
        title=get(body, "data.description_title", "data.metric_alert.alert_rule.name"), message=get(body, "data.description_text"), environment=get(m, "alert_rule.environment"), service=project,
    )
    return F.when(e.isNotNull() | resource.isin("error", "event_alert"), F.array(error)).when(m.isNotNull(), F.when(action.isin("critical", "warning"), F.array(metric))).when(i.isNotNull(), F.when(action.isin("created", "unresolved"), F.array(issue)))


def alertmanager(source: str):
    def parse(body: Column, headers: Column, config: Column) -> Each:
        def read(a: Column, x: dict[str, Column]) -> dict[str, Column]:
            return {"labels": merged(scalars(a, "labels"), x["common"]), "notes": scalars(a, "annotations"), "start": F.coalesce(get(a, "startsAt"), F.lit(""))}

        def one(a: Column, x: dict[str, Column]) -> list[Column]:
            labels, notes, start = x["labels"], x["notes"], x["start"]
            rule = pick(labels, "__alert_rule_uid__", "alertname")
            return fields(
                source=F.lit(source), kind=F.lit("alert"), external_id=F.concat(F.coalesce(get(a, "fingerprint"), normalize_message(rule)), F.lit("@"), start), occurred_at=parsed_time(start), severity=map_severity(F.lit(source), pick(labels, "severity", "priority"), F.lit("warning")),
                title=F.coalesce(pick(notes, "summary", "title"), pick(labels, "alertname")), message=pick(notes, "description", "message"), rule_id=rule, service=pick(labels, "service", "app", "application", "job", "namespace"), environment=pick(labels, "env", "environment", "stage"),
                attrs=F.map_concat(F.map_filter(labels, lambda k, _: ~k.startswith("__")), F.transform_keys(notes, lambda k, _: F.concat(F.lit("annotation."), k))),
            )

        alerts = F.variant_get(F.try_parse_json(body), "$.alerts", "array<variant>")
        firing = F.filter(F.transform(alerts, lambda v: F.to_json(v)), lambda a: F.lower(F.get_json_object(a, "$.status")) == "firing")
        return Each(firing, {"common": scalars(body, "commonLabels")}, read, one)

    return parse


def pagerduty(body: Column, headers: Column, config: Column) -> Column:
    d, kind = F.get_json_object(body, "$.event.data"), get(body, "event.event_type")
    severity = F.when(F.upper(get(d, "priority.summary")).isin("P1", "SEV-1", "SEV1"), "critical").otherwise(map_severity(F.lit("pagerduty"), get(d, "urgency"), F.lit("error")))
    rule = get(d, "service.id")
    e = event(source=F.lit("pagerduty"), kind=F.lit("alert"), external_id=get(body, "event.id"), occurred_at=parsed_time(get(body, "event.occurred_at")), severity=severity, title=get(d, "title"), service=get(d, "service.summary", "service.name"), rule_id=F.concat(rule, F.lit(":"), normalize_message(get(d, "title"))))
    return F.when(kind.isin("incident.triggered", "incident.reopened", "incident.escalated"), F.array(e))


def opsgenie(body: Column, headers: Column, config: Column) -> Column:
    action, a = get(body, "action"), F.get_json_object(body, "$.alert")
    known = let(a, lambda a: F.struct(a.alias("a"), tags(a, "tags").alias("labels"), scalars(a, "details").alias("details"), action.alias("action")))
    return F.when(action.isin("Create", "EscalateNext", "Escalate", "UnAcknowledge"), F.array(let(known, opsgenie_alert)))


def opsgenie_alert(x: Column) -> Column:
    a, action, labels, details = x["a"], x["action"], x["labels"], x["details"]
    return event(
        source=F.lit("opsgenie"), kind=F.lit("alert"), external_id=F.concat_ws(":", get(a, "alertId"), action, F.coalesce(get(a, "updatedAt"), F.lit(""))), occurred_at=parsed_time(get(a, "updatedAt", "createdAt")), severity=map_severity(F.lit("opsgenie"), get(a, "priority"), F.lit("warning")), title=get(a, "message"), message=get(a, "description"),
        rule_id=get(a, "alias", "message"), service=F.coalesce(pick(details, "service"), pick(labels, "service"), get(a, "entity")), environment=F.coalesce(pick(details, "environment", "env"), pick(labels, "env", "environment")), attrs=merged(details, labels),
    )


def items(body: Column, *members: str) -> Column:
    """The objects of a delivery: an array, the first array among members, or the object itself."""
    listed = [F.get_json_object(body, f"$.{m}") for m in members]
    found = F.coalesce(F.when(F.trim(body).startswith("["), body), *(F.when(x.startswith("["), x) for x in listed))
    return F.when(found.isNotNull(), F.transform(F.try_parse_json(found).cast("array<variant>"), lambda v: F.to_json(v))).otherwise(F.array(body))


def datadog(body: Column, headers: Column, config: Column) -> Column:
    def move(v: Column) -> Column:
        return F.lower(F.coalesce(get(v, "transition", "alert_transition"), F.lit("")))

    def wanted(v: Column) -> Column:
        kind = F.lower(F.coalesce(get(v, "alert_type"), F.lit("")))
        return ~move(v).contains("recover") & ~((move(v) == "") & kind.isin("success", "info"))

    def one(v: Column) -> Column:
        return let(tags(v, "tags"), lambda t: alert(v, t))

    def alert(v: Column, t: Column) -> Column:
        severity = F.when(F.upper(get(v, "priority")) == "P1", "critical").when(move(v).contains("warn"), "warning").otherwise(map_severity(F.lit("datadog"), F.lower(get(v, "alert_type")), F.lit("warning")))
        return event(source=F.lit("datadog"), kind=F.lit("alert"), external_id=get(v, "id", "event_id"), occurred_at=parsed_time(get(v, "date", "last_updated")), severity=severity, title=get(v, "title", "event_title"), message=get(v, "msg", "text", "body", "event_msg"), rule_id=get(v, "alert_id", "monitor_id", "aggreg_key"), service=pick(t, "service"), environment=pick(t, "env", "environment"), attrs=t)

    return F.transform(F.filter(items(body), wanted), one)


def aws(body: Column, headers: Column, config: Column) -> Column:
    d, kind = F.get_json_object(body, "$.detail"), get(body, "detail-type")
    at = parsed_time(get(body, "time"))
    alarm = event(source=F.lit("cloudwatch"), kind=F.lit("alert"), severity=F.lit("error"), external_id=get(body, "id"), rule_id=get(body, "resources[0]", "detail.alarmName"), title=get(d, "alarmName"), message=get(d, "state.reason"), occurred_at=F.coalesce(parsed_time(get(d, "state.timestamp")), at))
    score = F.coalesce(get(d, "severity").try_cast("double"), F.lit(0.0))
    guard = event(source=F.lit("guardduty"), kind=F.lit("security_finding"), severity=F.when(score >= 9, "critical").when(score >= 7, "error").when(score >= 4, "warning").otherwise("info"), external_id=F.concat(get(d, "id", "arn"), F.lit(":"), F.coalesce(get(d, "updatedAt"), F.lit(""))), rule_id=get(d, "type"), resource_id=get(d, "resource.instanceDetails.instanceId", "resource.accessKeyDetails.accessKeyId", "resource.s3BucketDetails[0].name", "resource.resourceType"), title=get(d, "title"), message=get(d, "description"), occurred_at=at)
    health = event(source=F.lit("cloudwatch"), kind=F.lit("alert"), severity=F.lit("warning"), external_id=get(body, "id"), rule_id=get(d, "eventTypeCode"), title=get(d, "eventTypeCode", "service"), message=get(d, "eventDescription[0].latestDescription"), service=get(d, "service"), occurred_at=at)
    other = event(source=F.lit("cloudwatch"), kind=F.lit("alert"), severity=F.lit("warning"), external_id=get(body, "id"), rule_id=F.concat(get(body, "source"), F.lit(":"), kind), title=kind, message=d, occurred_at=at)
    return F.when(kind == "CloudWatch Alarm State Change", F.when(get(d, "state.value") == "ALARM", F.array(alarm))).when(kind == "GuardDuty Finding", F.array(guard)).when(kind == "AWS Health Event", F.array(health)).when(kind.isNotNull(), F.array(other))


def gcp(body: Column, headers: Column, config: Column) -> Column:
    i = F.get_json_object(body, "$.incident")
    labels, own = merged(scalars(i, "policy_user_labels"), scalars(i, "metadata.user_labels")), scalars(i, "resource.labels")
    e = event(
        source=F.lit("gcp"), kind=F.lit("alert"), external_id=get(i, "incident_id"), occurred_at=parsed_time(get(i, "started_at")), severity=map_severity(F.lit("gcp"), get(i, "severity"), F.lit("warning")), title=get(i, "summary", "policy_name"), message=get(i, "documentation.content"), rule_id=F.concat_ws("/", F.coalesce(get(i, "policy_name"), F.lit("")), F.coalesce(get(i, "condition_name"), F.lit(""))),
        service=F.coalesce(pick(labels, "service"), pick(own, "service_name", "service", "module_id", "function_name", "container_name")), environment=pick(labels, "env", "environment"), attrs=labels,
    )
    return F.when(get(i, "state") == "open", F.array(e))


def wiz(body: Column, headers: Column, config: Column) -> Column:
    issue = F.coalesce(F.get_json_object(body, "$.issue"), body)
    thing = F.coalesce(F.get_json_object(body, "$.resource"), F.get_json_object(issue, "$.entitySnapshot"))
    name = F.coalesce(get(body, "control.name", "trigger.ruleName"), get(issue, "sourceRule.name", "control.name"), F.concat(F.lit("Wiz issue "), get(issue, "id")))
    t = scalars(thing, "tags")
    e = event(
        source=F.lit("wiz"), kind=F.lit("security_finding"), external_id=get(issue, "id"), occurred_at=parsed_time(get(issue, "updatedAt", "statusChangedAt", "createdAt", "created")), severity=map_severity(F.lit("wiz"), F.coalesce(get(issue, "severity"), get(body, "control.severity", "severity")), F.lit("warning")),
        title=F.concat(name, F.coalesce(F.concat(F.lit(" on "), get(thing, "name")), F.lit(""))), message=get(body, "control.description"), rule_id=F.coalesce(get(body, "control.id", "trigger.ruleId"), get(issue, "sourceRule.id", "control.id")), resource_id=get(thing, "providerId", "externalId", "id"),
        service=F.coalesce(F.nullif(F.element_at(t, F.coalesce(F.nullif(config["service_tag"], F.lit("")), F.lit("service"))), F.lit("")), pick(t, "app", "application")), environment=F.coalesce(pick(t, "env", "environment"), get(thing, "subscriptionName")),
    )
    closed = F.coalesce(F.lower(get(body, "trigger.type")).isin("resolved", "rejected") | F.upper(get(issue, "status")).isin("RESOLVED", "REJECTED", "CLOSED"), F.lit(False))
    return F.when(~closed & get(issue, "id").isNotNull(), F.array(e))


#: Paths that a generic event's fields are looked for at, in order: fixed values.
GENERIC = {
    "title": "title name summary subject alert error.type", "message": "message msg description text body error.message details", "severity": "severity level priority status", "service": "service service_name app application component", "environment": "environment env stage",
    "occurred_at": "timestamp time occurred_at created_at date @timestamp", "external_id": "id event_id uuid alert_id", "kind": "kind type", "group_id": "group_id issue_id", "rule_id": "rule_id rule monitor_id check", "exception_type": "exception_type exception error.type error_class", "resource_id": "resource_id resource host hostname",
}
KINDS = {"error": "error", "exception": "error", "alert": "alert", "security": "security_finding", "security_finding": "security_finding", "log": "log_match", "log_match": "log_match", "event_bus": "event_bus"}


def mapped(v: Column, config: Column, name: str) -> Column:
    """A field of a generic or search event: at the configured path, else at the first of the default ones."""
    return F.coalesce(F.nullif(F.call_function("get_json_object", v, F.concat(F.lit("$."), config[f"field.{name}"])), F.lit("")), F.when(config[f"field.{name}"].isNull(), get(v, *GENERIC[name].split())))


def kind_named(word: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.lower(word))


def generic(body: Column, headers: Column, config: Column) -> Each:
    source = F.coalesce(F.nullif(F.lower(F.trim(config["source_name"])), F.lit("")), F.lit("generic"))

    def read(v: Column, x: dict[str, Column]) -> dict[str, Column]:
        return {f"field.{n}": mapped(v, x["config"], n) for n in GENERIC}

    def one(v: Column, x: dict[str, Column]) -> list[Column]:
        f = lambda n: x[f"field.{n}"]
        kind = F.coalesce(kind_named(f("kind")), kind_named(x["config"]["kind"]), F.lit("error"))
        rest = {n: f(n) for n in ("title", "message", "service", "environment", "external_id", "group_id", "rule_id", "exception_type", "resource_id")}
        return fields(source=x["source"], kind=kind, severity=map_severity(x["source"], f("severity"), F.lit("")), occurred_at=parsed_time(f("occurred_at")), attrs=scalars(v), **rest)

    return Each(items(body, "events", "alerts", "items", "records"), {"source": source, "config": config}, read, one)


def splunk(body: Column, headers: Column, config: Column) -> Column:
    name, sid, row = get(body, "search_name"), get(body, "sid"), F.get_json_object(body, "$.result")
    message = mapped(row, config, "message")
    first = F.trim(F.substring_index(F.ltrim(message), "\n", 1))
    e = event(
        source=F.lit("splunk"), kind=F.lit("alert"), external_id=F.coalesce(sid, name), occurred_at=parsed_time(get(row, "_time")), title=F.when((first != "") & (F.octet_length(first) < 200), F.concat(name, F.lit(": "), first)).otherwise(name), message=message,
        severity=map_severity(F.lit("splunk"), mapped(row, config, "severity"), F.lit("error")), service=mapped(row, config, "service"), environment=mapped(row, config, "environment"), rule_id=F.trim(F.concat_ws("/", get(body, "app"), name), F.lit("/")),
    )
    return F.when(row.isNotNull() & (F.size(F.json_object_keys(row)) > 0) & F.coalesce(name, sid).isNotNull(), F.array(e))


PARSERS = {"sentry": sentry, "alertmanager": alertmanager("alertmanager"), "grafana": alertmanager("grafana"), "pagerduty": pagerduty, "opsgenie": opsgenie, "datadog": datadog, "aws": aws, "gcp": gcp, "wiz": wiz, "generic": generic, "splunk": splunk}


def events(deliveries: DataFrame, source: str) -> DataFrame:
    """Events of deliveries (body, headers map, config map, any other columns) of one source: no row where there is nothing to report."""
    found = PARSERS[source](F.col("body"), F.col("headers"), F.col("config"))
    rest = [c for c in deliveries.columns if c not in ("body", "headers", "config")]
    if isinstance(found, Each):
        named = lambda x: [c.alias(f"__{n}") for n, c in x.items()]
        rows = deliveries.select(*rest, *named(found.shared), F.explode(found.things).alias("__v"))
        x = {n: F.col(f"__{n}") for n in found.shared}
        read = found.read(F.col("__v"), x)
        rows = rows.select("*", *named(read))
        return rows.select(*rest, *found.event(F.col("__v"), x | {n: F.col(f"`__{n}`") for n in read}))
    return deliveries.select(*rest, F.explode(found).alias("e")).select(*rest, "e.*")
