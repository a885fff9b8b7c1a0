"""Queries over links, architecture, extraction and navigation, and the remaining relational shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import graph as G
from millrace.operators import system as S
from millrace.plans.graph import EDGES_SQL, ENTITIES_SQL, edges, entities, key
from millrace.plans.issues import EVENTS_SQL
from millrace.plans.rules import rule_events
from millrace.session import table


def wired(c: DataFrame, size: Column):
    """Customers as repositories that call each other's hosts and run each other's images; size: the range of the ids they point at."""
    repos = c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("acme/svc"), F.col("c_custkey").cast("string")).alias("name"), F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("pay"), F.col("c_custkey").cast("string"))).alias("service"))
    t = lambda d: (F.col("c_custkey") * 7 % size + d).cast("string")
    wires = c.select(F.col("c_custkey").alias("repo"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in (("host", F.concat(F.lit("h"), F.col("c_custkey").cast("string"), F.lit(".acme.io"))), ("calls", F.concat(F.lit("h"), t(1), F.lit(".acme.io"))), ("calls", F.concat(F.lit("svc"), t(2), F.lit(".prod.svc"))), ("calls", F.concat(F.lit("svc"), t(3), F.lit(".com"))), ("image_use", F.concat(F.lit("ghcr.io/acme/svc"), t(4))), ("ci_ref", F.concat(F.lit("acme/svc"), t(5))))))).alias("w")).select("repo", "w.*")
    return S.wiring_links(repos, wires)


def wiring(spark: SparkSession, folder: str):
    """The links among all customers, who point at ids up to their number."""
    c = table(spark, folder, "customer")
    return wired(c.crossJoin(F.broadcast(c.agg(F.count("*").alias("customers")))), F.col("customers"))


def packages(spark, folder):
    repos = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Acme/"), F.col("n_name")).alias("full_name"))
    deps = table(spark, folder, "customer").select(F.col("c_nationkey").alias("repo"), F.concat(F.element_at(F.array(*map(F.lit, ["@acme/", "github.com/acme/", "x/acme/", "acmex/"])), (F.col("c_custkey") % 4 + 1).cast("int")), F.concat(F.lit("nation_"), (F.col("c_custkey") % 25).cast("string")), F.when(F.col("c_custkey") % 3 == 0, "/v2").otherwise("")).alias("name"))
    return S.package_links(deps, repos.withColumn("full_name", F.concat(F.lit("acme/nation_"), F.col("id").cast("string"))))


def system_links(spark, folder):
    """Links between all owners from all four sources: shared topics, edges, packages and wiring."""
    e, ent = edges(spark, folder), entities(spark, folder)
    events = G.topic_links(e, ent.where("owner IS NOT NULL"))
    library = packages(spark, folder).select(key("n", "repo").alias("source"), key("n", "id").alias("target"), F.lit("library").alias("kind"), F.col("name").alias("via"))
    config = wiring(spark, folder).select(key("c", "source").alias("source"), key("c", "target").alias("target"), "kind", "via")
    # links by topic have a kind of their own and come one for each source, target and topic: they need not be summed again
    return events.unionByName(G.system_links(G.edge_links(e, ent), library, config))


def endpoint_groups(spark, folder):
    o = table(spark, folder, "orders")
    name = F.concat(F.element_at(F.array(*map(F.lit, ["GET /api/v1/", "POST /v2/", "GET /api/", "/", "PUT /api/v1/{id}/"])), (F.col("o_orderkey") % 5 + 1).cast("int")), F.lower(F.substring("o_orderpriority", 3, 20)), F.lit("/"), (F.col("o_orderkey") % 7).cast("string"))
    out = S.grouped_endpoints(o.select(F.col("o_orderstatus").alias("repo"), name.alias("name")))
    return out.select("repo", "group", "count", F.array_join("items", "|").alias("items"))


def extracted_facts(spark, folder):
    d = table(spark, folder, "documents")
    code = F.concat(F.lit('router.Get("/'), F.col("lang"), F.lit('/x"); os.Getenv("'), F.upper("lang"), F.lit('_REDIS_URL"); producer.publish("t-'), F.col("source"), F.lit('"); cache.get("key"); consumer.subscribe("q.'), F.col("lang"), F.lit('"); process.env.PORT\n'), F.col("text"))
    return S.extracted(d.select(F.col("doc_id").alias("path"), code.alias("content"))).groupBy("kind", "name").agg(F.count("*").alias("files"))


def module_calls(spark, folder):
    li = table(spark, folder, "lineitem")
    calls = li.groupBy(F.col("l_partkey").cast("string").alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst")).agg(F.count("*").alias("n"))
    parts = table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("path"), F.col("p_brand").alias("module"))
    supp = table(spark, folder, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("module"))
    return S.module_edges(calls, parts.unionByName(supp))


def modules(spark, folder):
    d = table(spark, folder, "documents")
    return S.split_modules(d.select(F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("n_chars").alias("lines")), most=60_000, least=3_000).groupBy("module").agg(F.count("*").alias("files"))


def navigation(spark, folder):
    q = spark.range(20).withColumnRenamed("id", "query_id")
    d = table(spark, folder, "documents")
    score = lambda c: F.pmod(F.xxhash64("query_id", c), F.lit(100)) / 100.0
    top = d.select(F.col("lang").alias("path")).distinct().withColumn("parent", F.lit(None).cast("string"))
    sub = d.select(F.concat_ws("/", "lang", "source").alias("path"), F.col("lang").alias("parent")).distinct()
    dirs = q.join(F.broadcast(top.unionByName(sub))).withColumn("score", score("path"))
    files = q.join(d.select(F.col("doc_id").cast("string").alias("path"), F.concat_ws("/", "lang", "source").alias("dir"))).withColumn("score", score("path"))
    return S.navigated(dirs, files)


def decode_freshness(spark, folder):
    d = table(spark, folder, "documents")
    chunks = d.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 6 == 0, F.lit("new")).otherwise(F.col("lang")).alias("content_hash"), F.when(F.col("doc_id") % 11 == 0, F.lit("gone")).alias("deleted_at"))
    blamed = F.filter(F.array(F.struct(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("hash"))), lambda a: a["chunk_id"] % 4 != 0)
    decodes = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("version"), blamed.alias("affected"))
    return S.standing_decodes(decodes, chunks, 1)


def rule_dry_run(spark, folder):
    return S.dry_run(rule_events(spark, folder).where("not suppressed"), {"id": "t", "action": "suppress", "match": {"sources": ["s1", "s2"]}}, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))


def issues_with_terms(spark, folder):
    return S.any_term(table(spark, folder, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("title")), ["steel", "#12"])


def composite_lookup(spark, folder):
    """Rows at a list of (order, line) pairs: the second line of each finished order."""
    li = table(spark, folder, "lineitem")
    wanted = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(2).alias("l_linenumber")).distinct()
    return li.join(wanted, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey")


def distinct_per_repo(spark, folder):
    return table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("parts"))


def cited_scopes(spark, folder):
    li = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("scopes"))


def path_chunks(spark, folder):
    d = table(spark, folder, "documents")
    return d.groupBy("lang", "source").agg(F.count("*").cast("int").alias("chunks")).where(F.col("source").ilike("%1%"))


QUERIES = {f.__name__: f for f in (wiring, packages, system_links, endpoint_groups, extracted_facts, module_calls, modules, navigation, decode_freshness, rule_dry_run, issues_with_terms, composite_lookup, distinct_per_repo, cited_scopes, path_chunks)}
ORACLES = {
    "wiring": """WITH c AS (SELECT c_custkey AS k, c_custkey * 7 % (SELECT count(*) FROM customer) AS t FROM customer), l AS (
  SELECT k, t + 1 AS o, 'api' AS kind, 'h' || (t + 1) || '.acme.io' AS via FROM c UNION ALL SELECT k, t + 2, 'api', 'svc' || (t + 2) || '.prod.svc' FROM c UNION ALL SELECT k, t + 4, 'image', 'ghcr.io/acme/svc' || (t + 4) FROM c UNION ALL SELECT k, t + 5, 'pipeline', 'acme/svc' || (t + 5) FROM c)
SELECT k AS source, o AS target, kind, via FROM l WHERE k <> o AND o IN (SELECT k FROM c)""",
    "packages": """SELECT DISTINCT c_nationkey AS repo, n_nationkey AS id, (['@acme/', 'github.com/acme/', 'x/acme/', 'acmex/'])[c_custkey % 4 + 1] || 'nation_' || (c_custkey % 25) || CASE WHEN c_custkey % 3 = 0 THEN '/v2' ELSE '' END AS name FROM customer JOIN nation ON n_nationkey = c_custkey % 25
WHERE c_nationkey <> n_nationkey AND c_custkey % 4 <> 3 AND (c_custkey % 4 <> 0 OR c_custkey % 3 <> 0)""",
    "endpoint_groups": r"""WITH e AS (SELECT o_orderstatus AS repo, (['GET /api/v1/', 'POST /v2/', 'GET /api/', '/', 'PUT /api/v1/{id}/'])[o_orderkey % 5 + 1] || lower(substring(o_orderpriority, 3, 20)) || '/' || (o_orderkey % 7) AS name, o_orderkey % 5 = 4 AS r, lower(substring(o_orderpriority, 3, 20)) AS p FROM orders)
SELECT repo, CASE WHEN r THEN '/' WHEN strpos(p, '/') > 0 THEN '/' || split_part(p, '/', 1) WHEN name LIKE '/%' AND strpos(name, ' ') > 0 THEN '/' || split_part(split_part(name, ' ', 2), '/', 1) ELSE '/' || p END AS "group", count(*) AS count, array_to_string(list_sort(list_distinct(list(name)))[1:50], '|') AS items FROM e GROUP BY 1, 2""",
    "module_calls": "WITH f AS (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT p_brand AS a, 'nation' || s_nationkey AS b, CAST(sum(n) AS BIGINT) AS calls, count(*) AS files FROM f JOIN part ON p_partkey = p JOIN supplier ON s_suppkey = s GROUP BY 1, 2",
    "modules": """WITH f AS (SELECT lang AS l1, lang || '/' || source AS l2, n_chars AS n FROM documents), a AS (SELECT sum(n) AS s0 FROM f), b AS (SELECT l1, sum(n) AS s1 FROM f GROUP BY 1), c AS (SELECT l2, sum(n) AS s2 FROM f GROUP BY 1),
  p AS (SELECT *, CASE WHEN s0 <= 60000 THEN '' WHEN s1 <= 60000 THEN l1 ELSE l2 END AS pick, CASE WHEN s0 <= 60000 THEN s0 WHEN s1 <= 60000 THEN s1 ELSE s2 END AS size FROM f JOIN b USING (l1) JOIN c USING (l2), a)
SELECT CASE WHEN size < 3000 AND pick = l2 THEN l1 WHEN size < 3000 AND pick = l1 THEN '' ELSE pick END AS module, count(*) AS files FROM p GROUP BY 1""",
    "decode_freshness": "SELECT doc_id AS id, doc_id % 5 <> 0 AND (doc_id % 4 = 0 OR (doc_id % 6 <> 0 AND doc_id % 11 <> 0)) AS fresh FROM documents",
    "rule_dry_run": f"WITH {EVENTS_SQL}, n AS (SELECT * FROM ev WHERE NOT suppressed AND received_at > TIMESTAMP '2024-01-13' QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY received_at DESC, event_id) = 1) SELECT fingerprint, event_id FROM n WHERE source IN ('s1', 's2')",
    "issues_with_terms": "SELECT p_partkey, p_brand || ' ' || p_type AS title FROM part WHERE strpos(lower(p_brand || ' ' || p_type), 'steel') > 0 OR strpos(p_brand, '#12') > 0",
    "composite_lookup": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND l_linenumber = 2",
    "distinct_per_repo": "SELECT o_custkey, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "cited_scopes": "SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS scopes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "path_chunks": "SELECT lang, source, CAST(count(*) AS INT) AS chunks FROM documents WHERE source ILIKE '%1%' GROUP BY 1, 2",
}
# edges but owns, publishes and subscribes, which are not links by themselves, do not occur in these tables
ORACLES["system_links"] = f"""WITH {ENTITIES_SQL}, {EDGES_SQL}, w AS (SELECT id, owner FROM ent WHERE owner IS NOT NULL), u AS (
  SELECT p.owner AS source, q.owner AS target, 'event' AS kind, x.dst AS via, x.src AS first FROM edge x JOIN w p ON p.id = x.src JOIN edge y ON y.dst = x.dst JOIN w q ON q.id = y.src WHERE x.kind = 'publishes' AND y.kind = 'subscribes' AND p.owner <> q.owner
  UNION ALL SELECT 'n:' || repo, 'n:' || id, 'library', name, NULL FROM ({ORACLES["packages"]}) UNION ALL SELECT 'c:' || source, 'c:' || target, kind, via, NULL FROM ({ORACLES["wiring"]}))
SELECT source, target, kind, via, count(*) AS links, min(first) AS first FROM u GROUP BY 1, 2, 3, 4"""
