"""Log lines and log batches: JSON lines, stack traces of four languages, compressed deliveries."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.functions.text import map_severity, severity_rank
from millrace.sources.webhooks import STACK

LEVEL = r"\b(FATAL|PANIC|CRITICAL|CRIT|SEVERE|ERROR|ERR|WARNING|WARN|NOTICE|INFO|DEBUG|TRACE)\b"
# Frames and exceptions by language.
PY_FRAME = r"File \"([^\"]+)\", line (\d+), in (\S+)"
PY_ERROR = r"(?m)^([A-Za-z_][\w.]*(?:Error|Exception|Exit|Interrupt|Warning|Fault)):?[ \t]?(.*)$"
JAVA_FRAME = r"(?m)^\s+at ([\w$.<>/]+)\.([\w$<>-]+)\(([^:)\n]*)(?::(\d+))?\)"
JAVA_ERROR = r"(?m)^(?:Exception in thread \"[^\"]*\" )?(?:Caused by: )?([a-zA-Z_$][\w$]*(?:\.[a-zA-Z_$][\w$]*)+(?:Exception|Error|Throwable))(?::[ \t]*(.*))?$"
NODE_FRAME = r"(?m)^\s+at (?:(\S+) \()?(/?[^\s():]+):(\d+):\d+\)?\s*$"
NODE_ERROR = r"(?m)^(\w*Error): (.*)$"
GO_PANIC = r"(?m)^panic: (.*)$"
GO_FRAME = r"(?m)^([\w./*()\-]+)\(.*\)\n\t(\S+\.go):(\d+)"
LEVELS = ("level", "severity", "lvl", "['log.level']", "log.level", "levelname")
MESSAGES = ("message", "msg", "['error.message']", "error.message", "err", "error", "textPayload")
ERRORS = ("['exception.type']", "exception.type", "['error.type']", "error.type", "error.kind", "exc_type", "exception_class", "error_class")
TRACES = ("stack", "stack_trace", "stacktrace", "exception.stacktrace", "error.stack", "exc_info", "traceback")


def member(doc: Column, names: tuple[str, ...]) -> Column:
    paths = [("$" + n) if n.startswith("[") else "$." + n for n in names]
    found = [F.get_json_object(doc, p) for p in paths]
    return F.coalesce(*(F.when(~x.rlike(r"^[\[{]"), F.nullif(x, F.lit(""))) for x in found))


def frames(text: Column, pattern: str, module: int, function: int, file: int, line: int) -> Column:
    """Frames in the order of the text, from a pattern's groups (0: none)."""
    part = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    groups = {n: part(g) if g else F.transform(part(line), lambda _: F.lit("")) for n, g in (("module", module), ("function", function), ("file", file), ("line", line))}
    zipped = F.arrays_zip(*(F.transform(groups[n], lambda x: F.struct(x.alias("x"))) for n in groups))
    return F.transform(zipped, lambda z: F.struct(z["0"]["x"].alias("module"), z["1"]["x"].alias("function"), z["2"]["x"].alias("file"), F.coalesce(z["3"]["x"].try_cast("int"), F.lit(0)).alias("line"), F.lit(False).alias("in_app")))


def parsed_text(text: Column) -> Column:
    """struct<level, message, exception_type, stack> of a plain message or a stack trace; the top frame comes first."""
    none = F.array().cast(STACK)
    level = F.regexp_extract(text, LEVEL, 1)
    tail = F.concat(F.lit("Traceback"), F.substring_index(text, "Traceback", -1))
    last = lambda g: F.try_element_at(F.regexp_extract_all(tail, F.lit(PY_ERROR), F.lit(g)), F.lit(-1))
    out = lambda lv, m, e, s: F.struct(lv.alias("level"), m.alias("message"), e.alias("exception_type"), s.cast(STACK).alias("stack"))
    or_text = lambda m: F.coalesce(F.nullif(F.trim(m), F.lit("")), text)
    python = out(level, F.when(last(1).isNotNull(), F.trim(last(2))).otherwise(text), F.coalesce(last(1), F.lit("")), F.reverse(frames(text, PY_FRAME, 1, 3, 1, 2)))
    java = out(level, or_text(F.regexp_extract(text, JAVA_ERROR, 2)), F.regexp_extract(text, JAVA_ERROR, 1), frames(text, JAVA_FRAME, 1, 2, 3, 4))
    node = out(level, or_text(F.regexp_extract(text, NODE_ERROR, 2)), F.regexp_extract(text, NODE_ERROR, 1), frames(text, NODE_FRAME, 2, 1, 2, 3))
    named = F.transform(frames(text, GO_FRAME, 1, 1, 2, 3), lambda f: f.withField("module", F.when(f["module"].contains("."), F.regexp_replace(f["module"], r"\.[^.]*$", "")).otherwise(f["module"])).withField("function", F.regexp_replace(f["function"], r"^.*\.", "")))
    go = out(F.coalesce(F.nullif(level, F.lit("")), F.lit("PANIC")), F.regexp_extract(text, GO_PANIC, 1), F.lit("panic"), named)
    return F.when(text.contains("Traceback (most recent call last)"), python).when(text.rlike(JAVA_FRAME), java).when(text.rlike(NODE_FRAME), node).when(text.rlike(GO_PANIC), go).otherwise(out(level, text, F.lit(""), none))


def parsed(message: Column) -> Column:
    """parsed_text of a log message, or of the fields of a JSON line."""
    text = F.trim(message)
    trace = member(text, TRACES)
    inner = parsed_text(trace)
    blank = lambda c: F.coalesce(c, F.lit(""))
    json = F.struct(blank(member(text, LEVELS)).alias("level"), blank(member(text, MESSAGES)).alias("message"), blank(F.coalesce(member(text, ERRORS), inner["exception_type"])).alias("exception_type"), F.coalesce(inner["stack"], F.array().cast(STACK)).alias("stack"))
    return F.when(text.startswith("{") & F.try_parse_json(text).isNotNull(), json).otherwise(parsed_text(text))


def log_events(lines: DataFrame, message: str = "message", least: str = "warning") -> DataFrame:
    """lines with level, text, exception_type, stack and severity, of at least the given severity; an unknown level is an error."""
    p = lines.withColumn("__p", parsed(F.col(message)))
    severity = map_severity(F.lit("log"), F.nullif(F.col("__p.level"), F.lit("")), F.lit("error"))
    out = p.select(*lines.columns, F.col("__p.level").alias("level"), F.col("__p.message").alias("text"), F.col("__p.exception_type").alias("exception_type"), F.col("__p.stack").alias("stack"), severity.alias("severity"))
    return out.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(least)))


@F.pandas_udf(StringType())
def unpacked(data: pd.Series) -> pd.Series:
    """Text of records, gunzipped where they are compressed; null where that fails."""

    def one(raw) -> str | None:
        try:
            return (gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else bytes(raw)).decode("utf-8", "replace")
        except (OSError, EOFError, TypeError):
            return None

    return data.map(one)


def firehose(deliveries: DataFrame, least: str = "warning") -> DataFrame:
    """Log events of batch deliveries (body: {"records": [{"data": base64}]}): unpacked, exploded, parsed."""
    records = F.from_json("body", "struct<records:array<struct<data:string>>>")["records"]
    raw = deliveries.select(F.explode(records).alias("r")).select(unpacked(F.try_to_binary(F.col("r.data"), F.lit("base64"))).alias("doc")).where("doc IS NOT NULL")
    schema = "struct<logGroup:string,logStream:string,logEvents:array<struct<id:string,timestamp:bigint,message:string>>>"
    each = raw.select(F.from_json("doc", schema).alias("d")).select("d.logGroup", "d.logStream", F.explode("d.logEvents").alias("e"))
    lines = each.select(F.col("logGroup").alias("log_group"), F.col("logStream").alias("log_stream"), F.col("e.id").alias("external_id"), F.timestamp_millis("e.timestamp").alias("occurred_at"), F.col("e.message").alias("message"))
    service = F.element_at(F.split(F.col("log_group"), "/"), -1)
    return log_events(lines, "message", least).withColumn("service", service)


def new_rows(rows: DataFrame, at: str, key: str, cursor: tuple[str, list[str]] | None) -> DataFrame:
    """Rows behind a poll cursor: newer than its time, or at that time and not yet seen."""
    if cursor is None:
        return rows
    time, seen = F.lit(cursor[0]).cast("timestamp"), cursor[1]
    tie = (F.col(at) == time) & (~F.col(key).isin(*seen) if seen else F.lit(True))
    return rows.where((F.col(at) > time) | tie)


def next_cursor(rows: DataFrame, at: str, key: str, most: int = 200) -> DataFrame:
    """One row: the newest time and up to most keys at it."""
    newest = rows.groupBy(at).agg(F.slice(F.sort_array(F.collect_set(key)), 1, most).alias("seen")).orderBy(F.col(at).desc()).limit(1)
    return newest.withColumnRenamed(at, "newest")
