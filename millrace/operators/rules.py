"""Rules kept as data: known issues, shelves, suggestions, search terms, frames to chunks, mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import SEVERITIES, severity_rank

#: Longest pattern that a rule may bring.
PATTERN_CHARS = 2000


def rule_condition(rule: dict, now: Column) -> Column:
    """A rule (id, action, expires_at, match) as one condition over events; empty lists and missing keys say nothing."""
    m, out = rule.get("match", {}), F.lit(True)
    if rule.get("expires_at"):
        out = out & (now < F.lit(rule["expires_at"]).cast("timestamp_ntz"))
    if m.get("fingerprints"):
        out = out & (F.col("fingerprint").isin(*m["fingerprints"]) | F.coalesce(F.col("alt_fingerprint").isin(*m["fingerprints"]), F.lit(False)))
    for key, column in (("sources", "source"), ("services", "service"), ("environments", "environment")):
        if m.get(key):
            out = out & F.lower(column).isin(*[x.lower() for x in m[key]])
    for k, v in m.get("attrs", {}).items():
        out = out & F.coalesce(F.element_at("attrs", F.lit(k)) == v, F.lit(False))
    for key, compare in (("min_severity", "__ge__"), ("max_severity", "__le__")):
        if m.get(key):
            out = out & getattr(severity_rank(F.col("severity")), compare)(SEVERITIES.index(m[key]) + 1)
    if m.get("message_regex"):
        if len(m["message_regex"]) > PATTERN_CHARS:
            raise ValueError("pattern too long")
        out = out & (F.coalesce(F.col("message").rlike(m["message_regex"]), F.lit(False)) | F.coalesce(F.col("title").rlike(m["message_regex"]), F.lit(False)))
    return F.coalesce(out, F.lit(False))


def matched(events: DataFrame, rules: list[dict], now: Column | None = None) -> DataFrame:
    """events with rule_id and action of the rule that applies: suppressing rules first, then the earliest. now: when the event is judged."""
    now = F.col("occurred_at") if now is None else now
    ordered = sorted(enumerate(rules), key=lambda r: (r[1]["action"] != "suppress", r[0]))
    pick = F.coalesce(*(F.when(rule_condition(r, now), F.struct(F.lit(r["id"]).alias("id"), F.lit(r["action"]).alias("action"))) for _, r in ordered)) if rules else F.lit(None).cast("struct<id:string,action:string>")
    return events.withColumn("__rule", pick).withColumn("rule_id", F.col("__rule.id")).withColumn("action", F.col("__rule.action")).drop("__rule")


def hits(matched_events: DataFrame) -> DataFrame:
    return matched_events.where("rule_id IS NOT NULL").groupBy("rule_id", "action").agg(F.count("*").alias("hits"))


def shelves(rows: DataFrame, rules: dict[str, list[dict[str, list[str]]]]) -> DataFrame:
    """rows with shelves: names whose rules match; any rule, in a rule every field, in a field any value."""
    found = []
    for name, alternatives in rules.items():
        any_rule = F.lit(False)
        for rule in alternatives:
            every = F.lit(bool(rule))
            for column, values in rule.items():
                every = every & F.coalesce(F.col(column).isin(*values), F.lit(False))
            any_rule = any_rule | every
        found.append(F.when(any_rule, F.lit(name)))
    return rows.withColumn("shelves", F.array_compact(F.array(*found)))


def suggestions(issues: DataFrame, taken: DataFrame) -> DataFrame:
    """Issues no suggestion names yet, by service and environment. taken: issue_ids array. issues: id, fingerprint, service, environment, occurrences."""
    free = issues.join(taken.select(F.explode("issue_ids").alias("id")).distinct(), "id", "left_anti")
    row = F.struct("id", "fingerprint")
    return free.groupBy("service", "environment").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum("occurrences").alias("total")).select("service", "environment", F.col("rows.id").alias("issue_ids"), F.col("rows.fingerprint").alias("fingerprints"), "total")


# What counts as an exception, an error code, a quoted message and a cloud resource.
EXCEPTION = r"\b(?:[a-z_]\w*\.)*[A-Z][A-Za-z0-9_]*(?:Exception|Error|Fault|Panic|Timeout)\b"
CODE = r"\b(?:[A-Z]{2,10}[-_][0-9]{2,6}|E[0-9]{3,6}|HTTP[ /]?[45][0-9][0-9]|(?:status|code)[ =:]+[45][0-9][0-9])\b"
QUOTED = "[\"'`“]([^\"'`”\n]{8,200})[\"'`”]"
RESOURCE = r"(?:/aws/[\w./-]+|arn:aws:[\w:/.-]+|projects/[\w-]+/(?:subscriptions|topics)/[\w.-]+)"


def terms(text: Column, services: Column | None = None) -> Column:
    """struct of exceptions, codes, messages, resources and services found in a text: the first 20 of each, without repeats."""
    some = lambda p, g=0: F.array_distinct(F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(g)), 1, 20))
    low = F.lower(text)
    whole = lambda s: F.call_function("rlike", low, F.concat(F.lit(r"(?<![0-9a-z_])\Q"), F.lower(s), F.lit(r"\E(?![0-9a-z_])")))
    known = F.filter(services, lambda s: (F.length(s) >= 3) & (s != "unknown") & whole(s)) if services is not None else F.array().cast("array<string>")
    return F.struct(some(EXCEPTION).alias("exceptions"), some(CODE).alias("codes"), F.array_distinct(F.transform(some(QUOTED, 1), lambda m: F.trim(m))).alias("messages"), some(RESOURCE).alias("resources"), known.alias("services"))


def frame_chunks(frames: DataFrame, chunks: DataFrame) -> DataFrame:
    """The best chunk for each frame: its path ends with the chunk's or the reverse, the frame's function as symbol first, then the longest path, then the id.

    Files and paths meet by their endings, each once with each function and symbol: of equal paths and symbols the least id counts. frames: frame_id, file, function.
    chunks: chunk_id, path, symbol.
    """
    parts = lambda c: F.split(c, "/")
    endings = lambda c, first: F.transform(F.sequence(F.lit(1), F.size(parts(c))), lambda i: F.when(i >= first, F.array_join(F.slice(parts(c), i, F.size(parts(c))), "/")))
    wanted = frames.where("file IS NOT NULL").select("file", "function").distinct()
    held = chunks.where("path IS NOT NULL").groupBy("path", "symbol").agg(F.min("chunk_id").alias("chunk_id"))
    below = wanted.select("file", "function", F.explode(F.array_compact(endings(F.col("file"), 1))).alias("path")).join(held, "path")
    above = held.select("path", "symbol", "chunk_id", F.explode(F.array_compact(endings(F.col("path"), 2))).alias("file")).join(wanted, "file")
    order = F.struct((F.coalesce(F.col("symbol") != F.col("function"), F.lit(True))).alias("a"), (-F.length("path")).alias("b"), F.col("chunk_id"))
    best = below.unionByName(above).groupBy("file", F.col("function").alias("__function")).agg(F.min(order).alias("best")).withColumnRenamed("file", "__file")
    met = frames.join(best, (F.col("file") == F.col("__file")) & F.col("function").eqNullSafe(F.col("__function")))
    return met.groupBy("frame_id").agg(F.min("best").alias("best")).select("frame_id", F.col("best.chunk_id").alias("chunk_id"))


def mentions(texts: DataFrame, entities: DataFrame, shortest: int = 4) -> DataFrame:
    """id, entity and first (the token where it stands first) of whole-token entity names in texts. entities: entity, name."""
    token = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_][\p{L}\p{N}_./-]*[\p{L}\p{N}_]|[\p{L}\p{N}_]"), F.lit(0))
    each = texts.select("id", F.posexplode(token).alias("place", "name")).where(F.length("name") >= shortest).groupBy("id", "name").agg(F.min("place").alias("first"))
    return each.join(entities.select("entity", F.lower("name").alias("name")), "name").groupBy("id", "entity").agg(F.min("first").alias("first"))


#: Methods that make a pair of tokens an endpoint: fixed values.
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")


def route_mentions(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """id, entity and first (the token where it stands first) of endpoints, named METHOD /route, in texts (id, text). entities: entity, name."""
    tokens = F.filter(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}_/.-]+"), F.lit(0)), lambda w: w.isNotNull())
    each = texts.select("id", tokens.alias("w")).select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 2, F.lit(0))), lambda i: F.struct(F.upper(F.trim(F.get("w", i), F.lit("./"))).alias("method"), F.rtrim(F.get("w", i + 1), F.lit(".")).alias("route")))).alias("place", "p"))
    named = each.where(F.col("p.method").isin(*METHODS) & F.col("p.route").startswith("/")).groupBy("id", F.concat_ws(" ", "p.method", "p.route").alias("name")).agg(F.min("place").alias("first"))
    cut = F.split(F.trim("name"), " ", 2)
    known = entities.select("entity", F.concat_ws(" ", F.upper(F.get(cut, F.lit(0))), F.get(cut, F.lit(1))).alias("name")).where(F.get(F.split("name", " ", 2), F.lit(1)).rlike("^/."))
    return named.join(known, "name").groupBy("id", "entity").agg(F.min("first").alias("first"))


#: Code lines up to which a commented chunk uses its comment, characters that comment needs, and code lines up to which the fast model is used: fixed values.
ROUTES = {"thorough": (-1, 0, -1), "balanced": (3, 20, 25), "economy": (60, 60, 80)}


def route(lines: Column, comment_chars: Column, cached: Column, mode: str, fast: bool = True) -> Column:
    """How a chunk's document is made: reuse, comment, fast or full."""
    comment, chars, quick = ROUTES.get(mode, ROUTES["balanced"])
    return F.when(F.trim(F.coalesce(cached, F.lit(""))) != "", "reuse").when((F.lit(comment >= 0)) & (lines <= comment) & (comment_chars >= chars), "comment").when(F.lit(fast and quick >= 0) & (lines <= quick), "fast").otherwise("full")
