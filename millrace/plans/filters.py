"""Filters, patches, pages and mentions over whole tables. Parts, orders and documents stand in for pages, issues and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import resolve_service
from millrace.operators import changes as C
from millrace.operators import predicates as P
from millrace.operators import rules as R
from millrace.session import table
from millrace.sources.documents import plain_chunks


def job_search(spark, folder):
    """Optional filters: two that are set, a literal and a wildcard one among them, and two that are not."""
    named = table(spark, folder, "part")
    return P.where(named, P.contains_text("p_name", "RING"), P.like_text("p_type", "e_"), P.equals("p_size", None), P.any_of("p_brand", [])).select("p_partkey", "p_name", "p_type")


def job_lookup(spark, folder):
    """Rows by a list of ids and an optional filter that is set."""
    return P.where(table(spark, folder, "orders"), P.any_of("o_orderpriority", ["1-URGENT", "2-HIGH"]), P.equals("o_orderstatus", "F")).select("o_orderkey", "o_custkey")


def tree_roots(spark, folder):
    """Null-safe equality: nodes whose parent is the one given, here none."""
    docs = table(spark, folder, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.floor(F.col("doc_id") / 3)).alias("parent_id"))
    return docs.where(P.same("parent_id", None)).select("doc_id").withColumn("level", F.lit("root")).unionByName(docs.where(P.same("parent_id", 1)).select("doc_id").withColumn("level", F.lit("below 1")))


def sourced_issues(spark, folder):
    """Array membership: orders that a ship date's return flag is among."""
    li = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("sources"))
    return li.where(P.holds("sources", "R")).select("l_orderkey", F.size("sources").cast("long").alias("sources"))


def shown_issues(spark, folder):
    """Without a status filter all but hidden ones are shown, with one those asked for."""
    o = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "suppressed").when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("status"))
    default, asked = (o.where(P.status_filter("status", s)).groupBy("status").agg(F.count("*").alias("issues")).withColumn("filter", F.lit(name)) for name, s in (("default", []), ("asked", ["suppressed", "open"])))
    return default.unionByName(asked)


def patched_customers(spark, folder):
    """A patch that sets one column and leaves the other."""
    return P.patched(table(spark, folder, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), {"c_mktsegment": "NEW", "c_nationkey": None})


def severe_events(spark, folder):
    """Events of a severity or more."""
    kind = F.element_at(F.array(*map(F.lit, ["info", "warning", "error", "critical", "odd"])), (F.col("event_id") % 5 + 1).cast("int"))
    e = table(spark, folder, "events").select("event_id", kind.alias("severity"))
    return P.where(e, P.at_least("severity", "error")).groupBy("severity").agg(F.count("*").alias("events"))


def suffix_paths(spark, folder):
    """Paths that are, or end with, a given one."""
    d = table(spark, folder, "documents").select("doc_id", F.concat_ws("/", F.when(F.col("doc_id") % 3 > 0, F.col("lang")), F.when(F.col("doc_id") % 2 == 0, F.lit("lib")), F.concat(F.lit("file"), F.col("doc_id") % 5)).alias("path"))
    return d.where(P.at_path("path", "lib/file2")).select("doc_id", "path")


def decode_issues(spark, folder):
    """A join on a computed string: chunks at issues/<id>."""
    chunks = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("issues/"), (F.col("doc_id") * 2).cast("string")).alias("path"))
    issues = table(spark, folder, "orders").select(F.concat(F.lit("issues/"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey").alias("issue"))
    return chunks.join(issues, "path").select("chunk_id", "issue")


def first_parts(spark, folder):
    """A bounded list that says whether it was cut (top of a report)."""
    return P.with_truncation(table(spark, folder, "part").select("p_partkey", "p_brand"), ["p_brand", "p_partkey"], 100)


def plain_texts(spark, folder):
    """Files without a grammar as one chunk each; every eleventh is binary."""
    d = table(spark, folder, "documents")
    files = d.select(F.concat_ws("/", F.lit("etc"), F.col("doc_id").cast("string")).alias("path"), F.encode(F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("ab\x00"), F.col("text"))).otherwise(F.regexp_replace("text", r"[^\x00-\x7f]", "?")), "UTF-8").alias("content"))
    return plain_chunks(files).select("path", "language", F.sha2("content", 256).alias("content_hash"), "end_line")


def bumped_files(spark, folder):
    """Dependency manifests: only a major version, or a dependency that comes or goes, asks for documents."""
    d = table(spark, folder, "documents")
    line = lambda v: F.concat(F.lit("requests=="), v, F.lit(".1.0\nnumpy>=1.2\n"))
    old, new = line((F.col("doc_id") % 3).cast("string")), F.concat(line((F.col("doc_id") % 4).cast("string")), F.when(F.col("doc_id") % 5 == 0, F.lit("flask==2.0\n")).otherwise(""))
    files = d.select(F.concat_ws("/", "source", F.lit("requirements.txt")).alias("path"), F.lit("modified").alias("status"), F.lit(False).alias("binary"), F.lit("a").alias("old_hash"), F.col("doc_id").cast("string").alias("new_hash"), F.lit(0).alias("similarity"), old.alias("old_text"), new.alias("new_text"))
    return C.triage(files, []).groupBy("verdict", "reason").agg(F.count("*").alias("files"))


def endpoint_mentions(spark, folder):
    """Endpoints, as METHOD /route, that texts name: an own one stands before each document's words."""
    d = table(spark, folder, "documents")
    texts = d.select(F.col("doc_id").alias("id"), F.concat(F.lit("calls get /v1/"), F.col("source"), F.lit(". then "), F.coalesce("text", F.lit(""))).alias("text"))
    names = d.select(F.concat(F.lit("Get /v1/"), F.col("source")).alias("name")).distinct().unionByName(spark.range(1).select(F.lit("POST /none").alias("name")))
    return R.route_mentions(texts, names.select(F.col("name").alias("entity"), "name")).groupBy("entity", "first").agg(F.count("*").alias("documents"))


def mapped_services(spark, folder):
    """Services by the first rule whose globs, character classes among them, all match."""
    d = table(spark, folder, "documents")
    attrs = F.create_map(F.lit("host"), F.concat(F.col("lang"), F.lit("-"), (F.col("doc_id") % 10).cast("string")), F.lit("team"), F.col("source"))
    rules = [("low", {"host": "[d-e]?-[0-4]"}), ("high", {"host": "*-[5-9]", "team": "src[^1]*"}), ("fr", {"host": "FR-*"})]
    return d.select(resolve_service(F.lit(None).cast("string"), attrs, rules).alias("service")).groupBy("service").agg(F.count("*").alias("documents"))


QUERIES = {f.__name__: f for f in (job_search, job_lookup, tree_roots, sourced_issues, shown_issues, patched_customers, severe_events, suffix_paths, decode_issues, first_parts, plain_texts, bumped_files, endpoint_mentions, mapped_services)}
ORACLES = {
    "job_search": "SELECT p_partkey, p_name, p_type FROM part WHERE strpos(lower(p_name), 'ring') > 0 AND p_type ILIKE '%e_%'",
    "job_lookup": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'F'",
    "tree_roots": "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN doc_id // 3 END AS parent_id FROM documents) SELECT doc_id, 'root' AS level FROM d WHERE parent_id IS NOT DISTINCT FROM NULL UNION ALL SELECT doc_id, 'below 1' FROM d WHERE parent_id IS NOT DISTINCT FROM 1",
    "sourced_issues": "WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS sources FROM lineitem GROUP BY 1) SELECT l_orderkey, len(sources) AS sources FROM s WHERE 'R' = ANY(sources)",
    "shown_issues": """WITH o AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'suppressed' WHEN o_orderstatus = 'F' THEN 'resolved' ELSE 'open' END AS status FROM orders)
SELECT status, count(*) AS issues, 'default' AS filter FROM o WHERE status <> 'suppressed' GROUP BY 1 UNION ALL SELECT status, count(*), 'asked' FROM o WHERE status IN ('suppressed', 'open') GROUP BY 1""",
    "patched_customers": "SELECT c_custkey, coalesce('NEW', c_mktsegment) AS c_mktsegment, coalesce(NULL, c_nationkey) AS c_nationkey FROM customer",
    "severe_events": "SELECT CASE event_id % 5 WHEN 2 THEN 'error' ELSE 'critical' END AS severity, count(*) AS events FROM events WHERE event_id % 5 IN (2, 3) GROUP BY 1",
    "suffix_paths": "WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN lang || '/' ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN 'lib/' ELSE '' END || 'file' || doc_id % 5 AS path FROM documents) SELECT doc_id, path FROM d WHERE path = 'lib/file2' OR path LIKE '%/lib/file2'",
    "decode_issues": "SELECT doc_id AS chunk_id, o_orderkey AS issue FROM documents JOIN orders ON 'issues/' || (doc_id * 2) = 'issues/' || o_orderkey",
    "first_parts": "SELECT p_partkey, p_brand, (SELECT count(*) FROM part) > 100 AS truncated FROM part ORDER BY p_brand, p_partkey LIMIT 100",
    "plain_texts": r"""WITH f AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7f]', '?', 'g') AS t FROM documents WHERE doc_id % 11 <> 0 AND regexp_matches(text, '[^\x20\x09-\x0D]')), c AS (SELECT doc_id, left(t, 16384) AS t FROM f)
SELECT 'etc/' || doc_id AS path, 'text' AS language, sha256(t) AS content_hash, CAST(length(t) - length(replace(t, chr(10), '')) + 1 AS INT) AS end_line FROM c""",
    "bumped_files": """WITH f AS (SELECT doc_id % 3 <> doc_id % 4 OR doc_id % 5 = 0 AS major FROM documents) SELECT CASE WHEN major THEN 'proceed' ELSE 'abort' END AS verdict, CASE WHEN major THEN 'major dependency' ELSE 'minor dependency' END AS reason, count(*) AS files FROM f GROUP BY 1, 2""",
    "endpoint_mentions": "SELECT 'Get /v1/' || source AS entity, CAST(1 AS INT) AS first, count(*) AS documents FROM documents GROUP BY 1",
    "mapped_services": r"""SELECT CASE WHEN regexp_matches(lang, '^[d-e].$') AND doc_id % 10 <= 4 THEN 'low' WHEN doc_id % 10 >= 5 AND regexp_matches(lower(source), '^src[^1]') THEN 'high' WHEN lang = 'fr' THEN 'fr' ELSE 'unknown' END AS service, count(*) AS documents FROM documents GROUP BY 1""",
}
