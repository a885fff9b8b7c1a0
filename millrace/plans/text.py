"""Text functions over documents and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.session import table

#: A message with the shapes that normalising looks for, made of event columns (Spark and DuckDB).
MESSAGE = "concat('Failed ', event_type, ' for user ', user_id, ' at ', date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' from 10.0.', user_id % 256, '.7: \"', props, '\" /api/v', user_id % 9, '/x code 0x', lower(hex(event_id * 7919 + 4027576321)), ' took ', event_id % 97, '.5s')"


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", F.expr(MESSAGE).alias("message"))


def normalized_messages(spark: SparkSession, folder: str) -> DataFrame:
    return messages(spark, folder).select("event_id", T.normalize_message(F.col("message")).alias("normalized"))


def scrubbed_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.scrub(F.col("text")).alias("scrubbed"))


def redacted_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.groupBy("source").agg(F.sum(T.estimate_tokens(F.col("text"))).alias("tokens"), F.floor(F.sum(F.length("text")) / 4).alias("char_tokens"))


def content_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    path = F.concat(F.lit("docs/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select("doc_id", F.left(F.sha2(F.concat_ws("::", "source", path, F.lit("intro")), 256), F.lit(16)).alias("chunk_id"), F.sha2("text", 256).alias("content_hash"))


def question_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", T.question_fingerprint(F.col("text")).alias("fingerprint"), F.array_join(T.identifiers(F.col("text")), ",").alias("names"), T.is_overview_question(F.col("text")).alias("overview"))


def severities(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    word = F.element_at(F.array(*map(F.lit, ["P1", "high", " WARN ", "notice", "bogus", "", "fatal", "6"])), (F.col("event_id") % 8 + 1).cast("int"))
    source = F.element_at(F.array(*map(F.lit, ["pagerduty", "Opsgenie", "splunk", "other"])), (F.col("user_id") % 4 + 1).cast("int"))
    mapped = T.map_severity(source, word, F.lit("warning"))
    return events.select("event_id", mapped.alias("severity"), T.severity_rank(mapped).alias("rank"))


def slugs_and_order(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return part.select("p_partkey", T.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), T.natural_key(F.concat(F.col("p_brand"), F.lit(" v"), F.col("p_size").cast("string"))).alias("natural"))


def doc_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of documents taken as error messages."""
    docs = table(spark, folder, "documents")
    none = F.lit(None).cast("string")
    frames = F.array().cast("array<string>")
    main, alt = T.fingerprints(F.lit("error"), F.col("source"), F.col("lang"), none, F.lit("ValueError"), none, F.lit("order 12 failed"), frames, none, none, F.when(F.col("doc_id") % 3 == 0, F.col("doc_id").cast("string")))
    return docs.select("doc_id", main.alias("fingerprint"), alt.alias("alternative"))


SEVERITY_SQL = "CASE " + " ".join(f"WHEN lower(source) = '{s}' AND w = '{k}' THEN '{v}'" for s, m in T.BY_SOURCE.items() for k, v in m.items()) + " " + " ".join(f"WHEN w = '{k}' THEN '{v}'" for v, words in T.BY_WORD.items() for k in words.split()) + " ELSE 'warning' END"
_FILL = ",".join(f"'{w}'" for w in T.FILLER)
_NUL = "chr(0)"

QUERIES = {
    "normalized_messages": normalized_messages,
    "scrubbed_documents": scrubbed_documents,
    "redacted_documents": redacted_documents,
    "token_estimates": token_estimates,
    "content_ids": content_ids,
    "question_fingerprints": question_fingerprints,
    "severities": severities,
    "slugs_and_order": slugs_and_order,
    "doc_shapes": doc_shapes,
}
ORACLES = {
    # written out, so that it shares no pattern table with what it checks
    "normalized_messages": r"""SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(concat('Failed ', event_type, ' for user ', user_id, ' at ', strftime(ts, '%Y-%m-%d %H:%M:%S'), ' from 10.0.', user_id % 256, '.7: "', props, '" /api/v', user_id % 9, '/x code 0x', lower(to_hex(event_id * 7919 + 4027576321)), ' took ', event_id % 97, '.5s')), '[0-9]{4}-[0-9]{2}-[0-9]{2}[t ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?(?:z|[+-][0-9]{2}:?[0-9]{2})?', '<ts>', 'g'),
  '[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}', '<ts>', 'g'),
  '\b[0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?\b', '<ts>', 'g'),
  '\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b', '<uuid>', 'g'),
  '[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}', '<email>', 'g'),
  '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?\b', '<ip>', 'g'),
  '(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}', '<ip>', 'g'),
  '\"[^\"]*\"|''[^'']*''|`[^`]*`', '<str>', 'g'),
  '(?:[a-z][a-z0-9+.-]*:)?(?:/[^\t\n\f\r /]*)*/[^\t\n\f\r /]*[0-9][^\t\n\f\r ]*', '<path>', 'g'),
  '\b0x[0-9a-f]{8,}\b', '<hex>', 'g'),
  '\b[0-9]+(?:\.[0-9]+)?', '<n>', 'g'),
  '[\t\n\f\r ]+', ' ', 'g')) AS normalized FROM events""",
    # written out, so that it shares no pattern table with what it checks
    "scrubbed_documents": r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----', '<PRIVATE_KEY>', 'g'),
  '\beyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]+', '<JWT>', 'g'),
  '\b(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)[0-9A-Z]{16}\b', '<AWS_KEY>', 'g'),
  '(?i)(aws_secret_access_key|secret_access_key|aws_secret)([\"'']?[\t\n\f\r ]*[:=][\t\n\f\r ]*[\"'']?)[A-Za-z0-9/+=]{40}', '\1\2<AWS_SECRET>', 'g'),
  '\bAIza[0-9A-Za-z_-]{35}\b', '<GCP_API_KEY>', 'g'),
  '\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{40,})\b', '<GITHUB_TOKEN>', 'g'),
  '\bxox[abposr]-[A-Za-z0-9-]{10,}', '<SLACK_TOKEN>', 'g'),
  '\b(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\b', '<STRIPE_KEY>', 'g'),
  '\bsk-[A-Za-z0-9][A-Za-z0-9_-]{19,}', '<API_KEY>', 'g'),
  '(?i)\b(bearer|token)[\t\n\f\r ]+[A-Za-z0-9._~+/=-]{16,}', '\1 <TOKEN>', 'g'),
  '(?i)\b(basic)[\t\n\f\r ]+[A-Za-z0-9+/]{12,}={0,2}', '\1 <CREDENTIALS>', 'g'),
  '\b([a-zA-Z][a-zA-Z0-9+.-]*://[^:/\t\n\f\r @]+):([^@\t\n\f\r /]+)@', '\1:<PASSWORD>@', 'g'),
  '(?i)\b(password|passwd|pwd)([\"'']?[\t\n\f\r ]*[=:][\t\n\f\r ]*)(\"[^\"]*\"|''[^'']*''|[^;\t\n\f\r ,&\"''}]+)', '\1\2<PASSWORD>', 'g'),
  '(?i)\b(api[_-]?key|apikey|secret|client[_-]?secret|access[_-]?token|refresh[_-]?token|auth[_-]?token|token|private[_-]?key)([\"'']?[\t\n\f\r ]*[:=][\t\n\f\r ]*[\"'']?)([A-Za-z0-9._~+/-]{8,})', '\1\2<SECRET>', 'g') AS scrubbed FROM documents""",
    "token_estimates": "SELECT source, CAST(sum((strlen(text) + 3) // 4) AS BIGINT) AS tokens, CAST(sum(length(text)) // 4 AS BIGINT) AS char_tokens FROM documents GROUP BY source",
    "content_ids": "SELECT doc_id, left(sha256(concat_ws('::', source, 'docs/' || lang || '/' || doc_id || '.md', 'intro')), 16) AS chunk_id, sha256(text) AS content_hash FROM documents",
    "question_fingerprints": rf"""WITH w AS (SELECT conv_id, turn, text, list_filter(regexp_extract_all(lower(text), '{T.WORD}'), lambda x: x NOT IN ({_FILL})) AS words FROM conversations)
SELECT conv_id, turn, array_to_string(list_transform(words, lambda x: CASE WHEN regexp_matches(x, '[./]') THEN x WHEN strlen(x) > 4 AND x LIKE '%ies' THEN left(x, length(x) - 3) || 'y' WHEN strlen(x) > 3 AND x LIKE '%s' AND x NOT LIKE '%ss' THEN left(x, length(x) - 1) ELSE x END), ' ') AS fingerprint,
  array_to_string(list_sort(list_transform(list_filter(regexp_extract_all(text, '{T.NAME}'), lambda x: regexp_matches(x, '[./_0-9]') OR regexp_matches(x[2:], '[A-Z]')), lambda x: lower(x))), ',') AS names,
  regexp_matches(lower(text), '{T.SUBJECT}') AND regexp_matches(lower(text), '{T.ASK}') AS overview FROM w""",
    "severities": f"""WITH e AS (SELECT event_id, lower(trim((['P1', 'high', ' WARN ', 'notice', 'bogus', '', 'fatal', '6'])[event_id % 8 + 1])) AS w, (['pagerduty', 'Opsgenie', 'splunk', 'other'])[user_id % 4 + 1] AS source FROM events),
  m AS (SELECT event_id, {SEVERITY_SQL} AS severity FROM e) SELECT event_id, severity, CAST(list_position(['info', 'warning', 'error', 'critical'], severity) AS INT) AS rank FROM m""",
    "slugs_and_order": r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^\p{L}\p{N}]+', '-', 'g'), '^-|-$', '', 'g') AS slug,
  regexp_replace(p_brand, '[0-9].*$', '') || CASE WHEN regexp_matches(p_brand, '[0-9]') THEN lpad(CAST(CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS VARCHAR), 20, '0') ELSE '' END || ' v' || lpad(CAST(p_size AS VARCHAR), 20, '0') AS natural FROM part""",
    "doc_shapes": rf"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256('group' || {_NUL} || lower(source) || {_NUL} || doc_id || {_NUL}) ELSE content END AS fingerprint, CASE WHEN doc_id % 3 = 0 THEN content ELSE '' END AS alternative
FROM (SELECT doc_id, source, sha256(lower(source) || {_NUL} || lower(lang) || {_NUL} || 'valueerror' || {_NUL} || 'order <n> failed' || {_NUL} || '' || {_NUL}) AS content FROM documents)""",
}
