"""Graph, tree and change-data queries. Orders, customers, parts and suppliers stand in for entities, their keys for edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import changes as C
from millrace.operators import graph as G
from millrace.session import table


def key(kind: str, column: str):
    return F.concat(F.lit(kind + ":"), F.col(column).cast("string"))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(key("c", "c_custkey").alias("id"), F.lit("repo").alias("kind"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("owner"), F.when(F.col("c_custkey") % 17 == 0, F.lit("gone")).alias("deleted_at"))
    o = table(spark, folder, "orders").select(key("o", "o_orderkey").alias("id"), F.lit("symbol").alias("kind"), F.col("o_orderpriority").alias("name"), key("c", "o_custkey").alias("owner"), F.when(F.col("o_orderkey") % 23 == 0, F.lit("gone")).alias("deleted_at"))
    p = table(spark, folder, "part").select(key("p", "p_partkey").alias("id"), F.lit("topic").alias("kind"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("deleted_at"))
    return c.unionByName(o).unionByName(p)


def edges(spark: SparkSession, folder: str) -> DataFrame:
    owns = table(spark, folder, "orders").select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"), F.lit("owns").alias("kind"))
    uses = table(spark, folder, "lineitem").select(key("o", "l_orderkey").alias("src"), key("p", "l_partkey").alias("dst"), F.when(F.col("l_linenumber") % 2 == 0, "publishes").otherwise("subscribes").alias("kind"))
    return owns.unionByName(uses.distinct())


ENTITIES_SQL = """ent AS (SELECT 'c:' || c_custkey AS id, 'repo' AS kind, c_name AS name, NULL AS owner, CASE WHEN c_custkey % 17 = 0 THEN 'gone' END AS deleted_at FROM customer
  UNION ALL SELECT 'o:' || o_orderkey, 'symbol', o_orderpriority, 'c:' || o_custkey, CASE WHEN o_orderkey % 23 = 0 THEN 'gone' END FROM orders UNION ALL SELECT 'p:' || p_partkey, 'topic', p_name, NULL, NULL FROM part)"""
EDGES_SQL = """edge AS (SELECT 'c:' || o_custkey AS src, 'o:' || o_orderkey AS dst, 'owns' AS kind FROM orders
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN 'publishes' ELSE 'subscribes' END FROM lineitem)"""


def entity_edges(spark, folder):
    return G.with_ends(edges(spark, folder), entities(spark, folder)).groupBy("src_kind", "kind", "dst_kind", "src_name").agg(F.count("*").alias("edges"))


def starts(spark, folder):
    return table(spark, folder, "customer").where("c_custkey % 50 = 0").select(key("c", "c_custkey").alias("id"))


def neighbourhoods(spark, folder):
    return G.neighbourhood(edges(spark, folder), starts(spark, folder), 2)


def symbol_neighbours(spark, folder):
    return G.neighbours(edges(spark, folder), starts(spark, folder), "symbol", entities(spark, folder))


def orphan_entities(spark, folder):
    """Entities that no use names: all repositories, as owning is left out, and symbols that use nothing."""
    return G.orphans(entities(spark, folder), edges(spark, folder).where("kind <> 'owns'")).select("id", "kind")


def overview_nodes(spark, folder):
    return G.overview(entities(spark, folder), edges(spark, folder), ["repo", "topic"], 200)[0].select("id", "degree")


def overview_edges(spark, folder):
    """Edges between the repositories with most of them: orders stand for their customers, parts for a customer as well."""
    ent = entities(spark, folder)
    owned = ent.withColumn("owner", F.when(F.col("kind") == "topic", F.concat(F.lit("c:"), (F.substring("id", 3, 20).cast("long") % 90 + 1).cast("string"))).otherwise(F.col("owner")))
    return G.overview(owned, edges(spark, folder), ["repo"], 200)[1]


def tree(spark, folder):
    r = table(spark, folder, "region").select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"))
    n = table(spark, folder, "nation").select(key("n", "n_nationkey").alias("id"), key("r", "n_regionkey").alias("parent_id"))
    c = table(spark, folder, "customer").select(key("c", "c_custkey").alias("id"), key("n", "c_nationkey").alias("parent_id"))
    return r.unionByName(n).unionByName(c)


TREE_SQL = "tree AS (SELECT 'r:' || r_regionkey AS id, NULL AS parent_id FROM region UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey FROM nation UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey FROM customer)"


def tree_ancestors(spark, folder):
    return G.ancestors(tree(spark, folder))


def tree_children(spark, folder):
    return G.children(tree(spark, folder))


def stored_chunks(spark, folder):
    return table(spark, folder, "documents").where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.when(F.col("doc_id") % 9 == 0, "generated_doc").otherwise("code").alias("source"), F.col("n_chars").cast("string").alias("hash"), (F.col("doc_id") % 7 != 0).alias("live"))


def fresh_chunks(spark, folder):
    once = table(spark, folder, "documents").where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.when(F.col("doc_id") % 9 == 0, "imported_doc").otherwise("code").alias("source"), F.when(F.col("doc_id") % 6 == 0, F.lit("new")).otherwise(F.col("n_chars").cast("string")).alias("hash"), F.col("doc_id").alias("ordinal"))
    return once.unionByName(once.where("id % 10 = 1").withColumn("hash", F.lit("later")).withColumn("ordinal", F.col("ordinal") + 10**9))


def manifest(spark, folder):
    affected = table(spark, folder, "documents").where("source in ('src1', 'src2', 'src3')").select(F.col("source").alias("path"))
    return C.manifest_diff(stored_chunks(spark, folder), fresh_chunks(spark, folder), affected)


def missing_ids(spark, folder):
    return C.missing(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), table(spark, folder, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


def missing_pairs(spark, folder):
    kept = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_suppkey")
    return C.missing(table(spark, folder, "lineitem").select("l_partkey", "l_suppkey").distinct(), kept, ["l_partkey", "l_suppkey"])


def folded_chunks(spark, folder):
    """Stored chunks with the fresh ones in their place, the last by its whole ordinal: two of one id have the same seq."""
    old = stored_chunks(spark, folder).select("id", "path", "hash", F.lit(0).alias("seq"), F.lit(0).cast("long").alias("ordinal"))
    new = fresh_chunks(spark, folder).select("id", "path", "hash", (F.col("ordinal") % 1000).cast("int").alias("seq"), "ordinal")
    return C.upserted(old, new, ["id"], "ordinal").drop("ordinal")


def rekeyed_vectors(spark, folder):
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "label")
    renames = rows.where("id % 10 = 0").select(F.col("id").alias("old"), (F.col("id") * 3).alias("new"))
    return C.rekeyed(rows, renames)


def triaged_files(spark, folder):
    d = table(spark, folder, "documents")
    files = d.select(F.concat(F.element_at(F.array(*map(F.lit, ["docs/", "src/", "vendor/x/", "lib/", ""])), (F.col("doc_id") % 5 + 1).cast("int")), F.col("source"), F.element_at(F.array(*map(F.lit, [".go", ".md", ".py", ".bin"])), (F.col("doc_id") % 4 + 1).cast("int"))).alias("path"), F.element_at(F.array(*map(F.lit, ["modified", "deleted", "renamed"])), (F.col("doc_id") % 3 + 1).cast("int")).alias("status"), (F.col("doc_id") % 11 == 0).alias("binary"), F.col("n_chars").alias("old_hash"), (F.col("n_chars") + F.col("doc_id") % 2).alias("new_hash"), (F.col("doc_id") % 100).alias("similarity"))
    return C.triage(files, ["vendor/**", "**/*.lock"]).groupBy("verdict", "reason").agg(F.count("*").alias("files"))


def graph_changes(spark, folder):
    e = edges(spark, folder).where("kind <> 'owns'")
    return C.graph_difference(e.where("src not like '%1'"), e.where("src not like '%2'"))


def content_keys(spark, folder):
    return C.content_key(table(spark, folder, "nation"), "n_regionkey", ["n_nationkey", "n_name"])


def repo_access(spark, folder):
    """Access directly or through a group: a set union."""
    direct = table(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderpriority").alias("repo"))
    group = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("repo"))
    return direct.union(group).distinct()


QUERIES = {f.__name__: f for f in (entity_edges, neighbourhoods, symbol_neighbours, orphan_entities, overview_nodes, overview_edges, tree_ancestors, tree_children, manifest, missing_ids, missing_pairs, folded_chunks, rekeyed_vectors, triaged_files, graph_changes, content_keys, repo_access)}
_TOP = """top AS (SELECT id, coalesce(d, 0) AS degree FROM ent LEFT JOIN (SELECT node, count(*) AS d FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1) ON node = id WHERE kind IN ('repo', 'topic') ORDER BY degree DESC, id LIMIT 200)"""
_ST = "st AS (SELECT doc_id AS id, source AS path, CASE WHEN doc_id % 9 = 0 THEN 'generated_doc' ELSE 'code' END AS source, CAST(n_chars AS VARCHAR) AS hash, doc_id % 7 <> 0 AS live FROM documents WHERE doc_id % 5 <> 0)"
_FR = "fr AS (SELECT doc_id AS id, source AS path, CASE WHEN doc_id % 9 = 0 THEN 'imported_doc' ELSE 'code' END AS source, CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE CAST(n_chars AS VARCHAR) END AS hash FROM documents WHERE doc_id % 4 <> 0)"
ORACLES = {
    "entity_edges": f"WITH {ENTITIES_SQL}, {EDGES_SQL} SELECT s.kind AS src_kind, edge.kind AS kind, d.kind AS dst_kind, s.name AS src_name, count(*) AS edges FROM edge JOIN ent s ON s.id = src AND s.deleted_at IS NULL JOIN ent d ON d.id = dst AND d.deleted_at IS NULL GROUP BY 1, 2, 3, 4",
    "neighbourhoods": f"""WITH RECURSIVE {EDGES_SQL}, both_ways AS (SELECT src AS node, dst AS other FROM edge UNION SELECT dst, src FROM edge), z AS (SELECT 'c:' || c_custkey AS id FROM customer WHERE c_custkey % 50 = 0),
  walk AS (SELECT id AS start, id AS node, 0 AS distance FROM z UNION SELECT start, other, distance + 1 FROM walk JOIN both_ways USING (node) WHERE distance < 2) SELECT start, node, min(distance) AS distance FROM walk GROUP BY 1, 2""",
    "symbol_neighbours": f"WITH {ENTITIES_SQL}, {EDGES_SQL}, z AS (SELECT 'c:' || c_custkey AS id FROM customer WHERE c_custkey % 50 = 0) SELECT DISTINCT n.id FROM z JOIN edge ON src = z.id OR dst = z.id JOIN ent n ON n.id = CASE WHEN src = z.id THEN dst ELSE src END WHERE n.kind = 'symbol' AND n.deleted_at IS NULL AND n.id NOT IN (SELECT id FROM z)",
    "orphan_entities": f"WITH {ENTITIES_SQL}, {EDGES_SQL} SELECT id, kind FROM ent WHERE deleted_at IS NULL AND id NOT IN (SELECT DISTINCT src FROM edge WHERE kind <> 'owns') AND id NOT IN (SELECT DISTINCT dst FROM edge WHERE kind <> 'owns')",
    "overview_nodes": f"WITH {ENTITIES_SQL}, {EDGES_SQL}, {_TOP} SELECT id, degree FROM top",
    "overview_edges": f"""WITH {ENTITIES_SQL}, {EDGES_SQL}, own AS (SELECT id, kind, CASE WHEN kind = 'topic' THEN 'c:' || (CAST(substring(id, 3) AS BIGINT) % 90 + 1) ELSE owner END AS owner FROM ent),
  top AS (SELECT id, coalesce(d, 0) AS degree FROM own LEFT JOIN (SELECT node, count(*) AS d FROM (SELECT src AS node FROM edge UNION ALL SELECT dst FROM edge) GROUP BY 1) ON node = id WHERE kind = 'repo' ORDER BY degree DESC, id LIMIT 200)
SELECT coalesce(s.owner, s.id) AS a, coalesce(d.owner, d.id) AS b, edge.kind AS kind, count(*) AS weight FROM edge JOIN own s ON s.id = src JOIN own d ON d.id = dst WHERE coalesce(s.owner, s.id) <> coalesce(d.owner, d.id) AND coalesce(s.owner, s.id) IN (SELECT id FROM top) AND coalesce(d.owner, d.id) IN (SELECT id FROM top) GROUP BY 1, 2, 3""",
    "tree_ancestors": f"WITH RECURSIVE {TREE_SQL}, up AS (SELECT id, parent_id AS ancestor, 1 AS depth FROM tree WHERE parent_id IS NOT NULL UNION ALL SELECT up.id, t.parent_id, depth + 1 FROM up JOIN tree t ON t.id = up.ancestor WHERE t.parent_id IS NOT NULL) SELECT id, ancestor, depth FROM up",
    "tree_children": f"WITH {TREE_SQL} SELECT id, parent_id, EXISTS (SELECT 1 FROM tree k WHERE k.parent_id = tree.id) AS has_children FROM tree",
    "manifest": f"""WITH {_ST}, {_FR} SELECT coalesce(st.id, fr.id) AS id, CASE WHEN fr.id IS NULL THEN 'removed' WHEN st.id IS NULL THEN 'added' WHEN fr.source = 'imported_doc' AND st.source = 'generated_doc' THEN 'skipped' WHEN NOT live AND st.hash = fr.hash THEN 'revived' WHEN NOT live THEN 'added' WHEN st.hash <> fr.hash OR st.source <> fr.source THEN 'changed' ELSE 'unchanged' END AS change
FROM st FULL JOIN fr ON st.id = fr.id WHERE fr.id IS NOT NULL OR (live AND st.path IN ('src1', 'src2', 'src3'))""",
    "missing_ids": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "missing_pairs": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = l.l_partkey AND r.l_suppkey = l.l_suppkey)",
    "folded_chunks": f"WITH {_ST}, {_FR}, n AS (SELECT id, path, hash, CAST(id % 1000 AS INT) AS seq FROM fr WHERE id % 10 <> 1 UNION ALL SELECT id, path, 'later', CAST((id + 1000000000) % 1000 AS INT) FROM fr WHERE id % 10 = 1) SELECT id, path, hash, seq FROM n UNION ALL SELECT id, path, hash, 0 FROM st WHERE id NOT IN (SELECT id FROM n)",
    "rekeyed_vectors": "WITH r AS (SELECT vec_id AS id, label FROM embeddings) SELECT id, label FROM r UNION ALL SELECT id * 3, label FROM r WHERE id % 10 = 0 AND id * 3 NOT IN (SELECT id FROM r)",
    "triaged_files": r"""WITH f AS (SELECT (['docs/', 'src/', 'vendor/x/', 'lib/', ''])[doc_id % 5 + 1] || source || (['.go', '.md', '.py', '.bin'])[doc_id % 4 + 1] AS path, (['modified', 'deleted', 'renamed'])[doc_id % 3 + 1] AS status, doc_id % 11 = 0 AS bin, doc_id % 2 = 0 AS same, doc_id % 100 AS similarity FROM documents),
  r AS (SELECT CASE WHEN path LIKE 'docs/%' THEN 'documentation' WHEN path LIKE 'vendor/%' OR path LIKE '%.lock' THEN 'ignored' WHEN path LIKE '%.md' AND status <> 'deleted' THEN 'markdown' WHEN bin THEN 'binary' WHEN status = 'deleted' THEN 'deleted' WHEN same AND status = 'renamed' THEN CASE WHEN similarity >= 90 THEN 'renamed' ELSE 'moved' END WHEN same THEN 'same content' ELSE 'changed' END AS reason FROM f)
SELECT CASE WHEN reason IN ('deleted', 'moved', 'changed') THEN 'proceed' ELSE 'abort' END AS verdict, reason, count(*) AS files FROM r GROUP BY 1, 2""",
    "graph_changes": f"WITH {EDGES_SQL}, e AS (SELECT * FROM edge WHERE kind <> 'owns') SELECT src, dst, kind, 'added' AS change FROM e WHERE src LIKE '%1' AND src NOT LIKE '%2' UNION ALL SELECT src, dst, kind, 'removed' FROM e WHERE src LIKE '%2'",
    "content_keys": "SELECT n_regionkey, sha256(string_agg(n_nationkey || chr(31) || n_name, chr(10) ORDER BY n_nationkey || chr(31) || n_name)) AS content FROM nation GROUP BY 1",
    "repo_access": "SELECT o_custkey, o_orderpriority AS repo FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
}
