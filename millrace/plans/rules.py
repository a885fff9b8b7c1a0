"""Rules and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.operators import rules as R
from millrace.plans.issues import EVENTS_SQL
from millrace.plans.issues import events as issue_events
from millrace.session import table

RULES = [
    {"id": "r1", "action": "label_only", "match": {"sources": ["S1"], "min_severity": "error"}},
    {"id": "r2", "action": "suppress", "match": {"message_regex": "7|9", "max_severity": "warning"}},
    {"id": "r3", "action": "suppress", "match": {"fingerprints": ["click:7", "view:3"]}, "expires_at": "2024-01-15 00:00:00"},
    {"id": "r4", "action": "label_only", "match": {"attrs": {"team": "t3"}}},
]


def rule_events(spark: SparkSession, folder: str) -> DataFrame:
    e = issue_events(spark, folder)
    return e.withColumn("alt_fingerprint", F.lit(None).cast("string")).withColumn("message", F.col("event_id").cast("string")).withColumn("title", F.lit("")).withColumn("attrs", F.create_map(F.lit("team"), F.concat(F.lit("t"), (F.col("event_id") % 5).cast("string"))))


def rule_matches(spark, folder):
    return R.matched(rule_events(spark, folder), RULES).select("event_id", "rule_id", "action")


def rule_hits(spark, folder):
    return R.hits(R.matched(rule_events(spark, folder), RULES))


def shelved_documents(spark, folder):
    rules = {"romance": [{"lang": ["fr", "es"]}], "first": [{"source": ["src0", "src1"], "lang": ["en"]}, {"source": ["src2"]}]}
    return R.shelves(table(spark, folder, "documents"), rules).select("doc_id", F.array_join("shelves", ",").alias("shelves"))


def open_suggestions(spark, folder):
    issues = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").cast("string").alias("fingerprint"), F.col("o_orderpriority").alias("service"), F.col("o_orderstatus").alias("environment"), F.col("o_custkey").alias("occurrences"))
    taken = issues.where("id % 6 = 0").groupBy("service").agg(F.collect_list("id").alias("issue_ids"))
    out = R.suggestions(issues, taken)
    return out.select("service", "environment", F.size("issue_ids").alias("issues"), F.element_at("issue_ids", 1).alias("first"), "total")


def found_terms(spark, folder):
    docs = table(spark, folder, "documents")
    text = F.concat(F.lit("java.io.IOException and "), F.col("source"), F.lit("Error-like PaymentTimeout ORD-"), (F.col("doc_id") % 1000 + 10).cast("string"), F.lit(" HTTP 503 said \"cannot reach host\" at /aws/lambda/pay-"), F.col("lang"), F.lit(" in "), F.col("lang"), F.lit("-svc"))
    t = R.terms(text, F.array(F.lit("en-svc"), F.lit("fr"), F.lit("svc")))
    return docs.select("doc_id", t.alias("t")).select("doc_id", *(F.array_join(F.col("t")[c], "|").alias(c) for c in ("exceptions", "codes", "messages", "resources", "services")))


def frames_to_chunks(spark, folder):
    part = table(spark, folder, "part")
    chunks = part.select(F.col("p_partkey").alias("chunk_id"), F.concat(F.lit("src/"), F.col("p_brand"), F.lit("/"), (F.col("p_partkey") % 50).cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")).alias("symbol"))
    frames = part.select(F.col("p_partkey").alias("frame_id"), F.concat(F.lit("/app/src/"), F.col("p_brand"), F.lit("/"), (F.col("p_partkey") % 50).cast("string"), F.lit(".py")).alias("file"), F.lit("f1").alias("function"))
    return R.frame_chunks(frames, chunks)


def entity_mentions(spark, folder):
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    words = F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^a-z]+"), lambda w: F.length(w) >= 7)))
    names = table(spark, folder, "benchmark").select(words.alias("name")).distinct()
    return R.mentions(texts, names.select(F.col("name").alias("entity"), "name")).groupBy("entity").agg(F.count("*").alias("documents"))


def document_routes(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", R.route(F.col("n_chars") % 120, F.col("n_chars") % 90, F.when(F.col("doc_id") % 8 == 0, F.lit("old")), "economy").alias("economy"), R.route(F.col("n_chars") % 30, F.col("n_chars") % 40, F.lit(None).cast("string"), "balanced").alias("balanced"))


def decisions(spark, folder):
    """Labels as wanted choices, a made-up probability that leans towards them."""
    l = table(spark, folder, "labels")
    p = 0.3 + (F.col("doc_id") % 70) / 100.0
    wanted = F.when(F.col("quality") == 1, "actionable").otherwise("known_noise")
    choice = F.when(F.col("doc_id") % 100 < 80, wanted).otherwise(F.when(F.col("quality") == 1, "known_noise").otherwise("actionable"))
    return l.select("doc_id", p.alias("p"), choice.alias("choice"), wanted.alias("wanted")).withColumn("probabilities", F.create_map("choice", "p"))


def reliability_bins(spark, folder):
    out = E.reliability(decisions(spark, folder))
    return out.select("bin", "count", F.round("mean_p", 9).alias("mean_p"), F.round("accuracy", 9).alias("accuracy"))


def calibration(spark, folder):
    out = E.calibration(decisions(spark, folder), 0.7, "known_noise")
    return out.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def citation_summary(spark, folder):
    docs = table(spark, folder, "documents")
    names = lambda *d: F.array_compact(F.array(*(F.when(F.col("doc_id") % x != 0, F.concat(F.lit("f"), (F.col("n_chars") % x).cast("string"))) for x in d)))
    return E.citation_summary(E.citation_scores(docs.select(F.col("doc_id").alias("id"), names(2, 3).alias("expected"), names(2, 5, 4).alias("cited"))))


def ordered_findings(spark, folder):
    """Findings by priority, verdict, file and line: each with its place."""
    p = table(spark, folder, "part").select("p_partkey", (F.col("p_size") % 4).alias("priority"), F.element_at(F.array(*map(F.lit, ["confirmed", "plausible", "rejected"])), (F.col("p_partkey") % 3 + 1).cast("int")).alias("verdict"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"))
    from pyspark.sql import Window

    return p.select("p_partkey", F.row_number().over(Window.partitionBy("file").orderBy(*E.finding_order())).alias("place"))


QUERIES = {f.__name__: f for f in (rule_matches, rule_hits, shelved_documents, open_suggestions, found_terms, frames_to_chunks, entity_mentions, document_routes, reliability_bins, calibration, citation_summary, ordered_findings)}
_M = f"""{EVENTS_SQL}, m AS (SELECT event_id, CASE WHEN regexp_matches(CAST(event_id AS VARCHAR), '7|9') AND r <= 1 THEN 'r2' WHEN fingerprint IN ('click:7', 'view:3') AND occurred_at < TIMESTAMP '2024-01-15' THEN 'r3' WHEN source = 's1' AND r >= 2 THEN 'r1' WHEN event_id % 5 = 3 THEN 'r4' END AS rule_id FROM ev),
  n AS (SELECT event_id, rule_id, CASE WHEN rule_id IN ('r2', 'r3') THEN 'suppress' WHEN rule_id IS NOT NULL THEN 'label_only' END AS action FROM m)"""
_D = """d AS (SELECT doc_id, CAST(0.3 AS DOUBLE) + (doc_id % 70) / CAST(100 AS DOUBLE) AS p, quality = 1 AS act, doc_id % 100 < 80 AS ok FROM labels)"""
ORACLES = {
    "rule_matches": f"WITH {_M} SELECT * FROM n",
    "rule_hits": f"WITH {_M} SELECT rule_id, action, count(*) AS hits FROM n WHERE rule_id IS NOT NULL GROUP BY 1, 2",
    "shelved_documents": "SELECT doc_id, array_to_string(list_filter([CASE WHEN lang IN ('fr', 'es') THEN 'romance' END, CASE WHEN (source IN ('src0', 'src1') AND lang = 'en') OR source = 'src2' THEN 'first' END], lambda x: x IS NOT NULL), ',') AS shelves FROM documents",
    "open_suggestions": "SELECT o_orderpriority AS service, o_orderstatus AS environment, CAST(count(*) AS INT) AS issues, min(o_orderkey) AS first, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders WHERE o_orderkey % 6 <> 0 GROUP BY 1, 2",
    "found_terms": "SELECT doc_id, 'java.io.IOException|PaymentTimeout' AS exceptions, CASE WHEN true THEN 'ORD-' || (doc_id % 1000 + 10) || '|HTTP 503' END AS codes, 'cannot reach host' AS messages, '/aws/lambda/pay-' || lang AS resources, array_to_string(list_filter([CASE WHEN lang = 'en' THEN 'en-svc' END, NULL, 'svc'], lambda x: x IS NOT NULL), '|') AS services FROM documents",
    "frames_to_chunks": """WITH c AS (SELECT p_partkey AS id, 'src/' || p_brand || '/' || (p_partkey % 50) || '.py' AS path, 'f' || (p_partkey % 3) AS symbol FROM part), f AS (SELECT p_partkey AS frame_id, '/app/src/' || p_brand || '/' || (p_partkey % 50) || '.py' AS file FROM part)
SELECT frame_id, id AS chunk_id FROM f JOIN c ON file = '/app/' || path QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY symbol <> 'f1', length(path) DESC, id) = 1""",
    "entity_mentions": r"""WITH n AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 7)) AS entity FROM benchmark), t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_][\p{L}\p{N}_./-]*[\p{L}\p{N}_]|[\p{L}\p{N}_]')) AS entity FROM documents) SELECT entity, count(*) AS documents FROM t JOIN n USING (entity) GROUP BY 1""",
    "document_routes": """SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN 'reuse' WHEN n_chars % 120 <= 60 AND n_chars % 90 >= 60 THEN 'comment' WHEN n_chars % 120 <= 80 THEN 'fast' ELSE 'full' END AS economy, CASE WHEN n_chars % 30 <= 3 AND n_chars % 40 >= 20 THEN 'comment' WHEN n_chars % 30 <= 25 THEN 'fast' ELSE 'full' END AS balanced FROM documents""",
    "reliability_bins": f"WITH {_D} SELECT CAST(greatest(least(floor(p * 10), 9), 0) AS INT) AS bin, count(*) AS count, round(avg(p), 9) AS mean_p, round(avg(CAST(ok AS DOUBLE)), 9) AS accuracy FROM d GROUP BY 1",
    "calibration": f"""WITH {_D}, b AS (SELECT count(*) AS c, avg(p) AS mp, avg(CAST(ok AS DOUBLE)) AS acc FROM d GROUP BY greatest(least(floor(p * 10), 9), 0)), e AS (SELECT sum(c * abs(acc - mp)) / sum(c) AS ece FROM b)
SELECT count(*) AS n, round(avg(CAST(ok AS DOUBLE)), 9) AS accuracy, round(avg(CASE WHEN ok THEN (p - 1) * (p - 1) ELSE p * p + 1 END), 9) AS brier, round(count(*) FILTER (WHERE p >= 0.7) / count(*), 9) AS coverage, round(count(*) FILTER (WHERE p >= 0.7 AND ok) / count(*) FILTER (WHERE p >= 0.7), 9) AS gated_accuracy,
  round(count(*) FILTER (WHERE p >= 0.7 AND act <> ok) / count(*), 9) AS noise_skip_rate, count(*) FILTER (WHERE p >= 0.7 AND act AND NOT ok) AS missed_defects, round((SELECT ece FROM e), 9) AS ece FROM d""",
    "citation_summary": """WITH d AS (SELECT list_filter([CASE WHEN doc_id % 2 <> 0 THEN 'f' || (n_chars % 2) END, CASE WHEN doc_id % 3 <> 0 THEN 'f' || (n_chars % 3) END], lambda x: x IS NOT NULL) AS ex, list_distinct(list_filter([CASE WHEN doc_id % 2 <> 0 THEN 'f' || (n_chars % 2) END, CASE WHEN doc_id % 5 <> 0 THEN 'f' || (n_chars % 5) END, CASE WHEN doc_id % 4 <> 0 THEN 'f' || (n_chars % 4) END], lambda x: x IS NOT NULL)) AS ci FROM documents),
  h AS (SELECT *, len(list_filter(ex, lambda x: list_contains(ci, x))) AS h FROM d), s AS (SELECT CASE WHEN len(ex) = 0 THEN CASE WHEN len(ci) = 0 THEN 1.0 ELSE 0.0 END WHEN len(ci) > 0 THEN h / len(ci) ELSE 0.0 END AS p, CASE WHEN len(ex) = 0 THEN CASE WHEN len(ci) = 0 THEN 1.0 ELSE 0.0 END ELSE h / len(ex) END AS r FROM h)
SELECT count(*) AS questions, floor(avg(CAST(p AS DOUBLE)) * 1000 + 0.5) / 1000 AS precision, floor(avg(CAST(r AS DOUBLE)) * 1000 + 0.5) / 1000 AS recall, floor(avg(CASE WHEN r > 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * 1000 + 0.5) / 1000 AS hit_rate FROM s""",
    "ordered_findings": "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 4, p_partkey % 3, p_brand, p_partkey) AS INT) AS place FROM part",
}
