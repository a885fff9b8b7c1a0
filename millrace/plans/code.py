"""Code and trees of files: documents stand in for files, with changes made to them by a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import changes as C
from millrace.operators import layers as L
from millrace.operators import ownership as O
from millrace.operators import snapshots as S
from millrace.operators import symbols as Y
from millrace.session import table
from millrace.sources.deployments import deployed_as, deployments


def snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All documents as files, and what a sevenfold rule makes of them: removed, moved with another line, moved, edited, or as they were."""
    docs = table(spark, folder, "documents")
    path, kind = F.format_string("%s/%s.txt", "source", "doc_id"), F.col("doc_id") % 7
    old = docs.select("doc_id", path.alias("path"), F.col("text").alias("content"))
    content = F.when(kind == 1, F.format_string("%s\nthe last line of %s", F.coalesce("text", F.lit("")), "doc_id")).when(kind == 3, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))
    new = docs.where(kind != 0).select("doc_id", F.when(kind.isin(1, 2), F.concat(F.lit("moved/"), path)).otherwise(path).alias("path"), content.alias("content"))
    return old, new


def similar_files(spark, folder):
    """All pairs of a file that went and one that came that share half of the larger one."""
    old, new = snapshots(spark, folder)
    return S.similar_pairs(old.where("doc_id % 7 < 3").select("path", "content"), new.where("doc_id % 7 in (1, 2)").select("path", "content"))


def change_feed(spark, folder):
    """All that differs between the snapshots. No SQL: assigning one to one goes round by round; see the tests."""
    old, new = snapshots(spark, folder)
    return S.change_feed(old.select("path", "content"), new.select("path", "content"))


def token_triage(spark, folder):
    """A source file of each document, changed in a comment, a blank, the wording of a text, or a number."""
    body = lambda remark, number, text, gap: F.concat(F.lit("package main // "), remark, F.lit("\nfunc f() {"), gap, F.lit("x := "), number, F.lit('; log("'), text, F.lit('") }\n'))
    kind = F.col("doc_id") % 4
    mark = lambda k, other, plain: F.when(kind == k, F.lit(other)).otherwise(F.lit(plain))
    old = body(F.col("source"), F.lit("1"), F.col("lang"), F.lit(" "))
    new = body(F.concat(F.col("source"), mark(0, "?", "")), mark(1, "2", "1"), F.concat(F.col("lang"), mark(2, "!", "")), mark(3, "\n\t", " "))
    files = table(spark, folder, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".go")).alias("path"), F.when(F.col("doc_id") % 3 == 0, "renamed").otherwise("modified").alias("status"), F.lit(False).alias("binary"), (F.col("doc_id") % 100).cast("int").alias("similarity"), old.alias("old_text"), new.alias("new_text"))
    files = files.withColumns({"old_hash": F.md5("old_text"), "new_hash": F.md5("new_text")})
    return C.triage(files, []).groupBy("verdict", "reason").agg(F.count("*").alias("files"))


PATHS = ["README.md", "src/main.go", "src/api/test_x.py", "docs/guide.md", "docs/internal/p.md", "web/app.js", "lib/a/b.c", "src/x.js"]


def owned_files(spark, folder):
    """The owners of a file for each document, by the owner file of its source as repository."""
    docs = table(spark, folder, "documents")
    team = F.concat(F.lit("@acme/"), "source")
    text = F.concat(F.lit("# owners\n* "), team, F.lit("\n*.js @web\n/docs/ @docs "), team, F.lit("\n[tests]\n/src/**/test_*.py @test\n/docs/internal/\nlib @lib # all of it\n"))
    known = O.rules(docs.select(F.col("source").alias("repo"), F.lit("CODEOWNERS").alias("path"), text.alias("content")).distinct())
    path = F.element_at(F.array(*map(F.lit, PATHS)), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.concat(F.regexp_replace(path, r"[^/]*$", ""), F.when(F.col("doc_id") % 8 == 2, F.concat(F.lit("test_"), "doc_id", F.lit(".py"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.regexp_extract(path, r"(\.[^.]*)$", 1))))
    found = O.file_owners(docs.select(F.col("source").alias("repo"), name.alias("path")), known)
    return found.select("repo", "path", F.array_join("owners", " ").alias("owners"), "pattern", F.col("line").cast("long").alias("line"))


def deployed_containers(spark, folder):
    """A deployment file of two objects for each document, read into rows."""
    docs = table(spark, folder, "documents")
    text = F.concat(F.lit("kind: Deployment\nmetadata:\n  name: svc-"), "doc_id", F.lit("\nspec:\n  template:\n    spec:\n      containers:\n      - name: main\n        image: 'acme/"), "source", F.lit(":"), F.col("n_chars").cast("string"), F.lit("' # pinned\n        env: [{name: LANG_"), "lang", F.lit("}, {name: MODE}]\n        ports:\n        - containerPort: "), (F.col("doc_id") % 9000 + 1000).cast("string"), F.lit("\n---\nkind: Service\nmetadata:\n  name: svc\n"))
    files = docs.select(F.col("source").alias("repo"), F.concat(F.lit("deploy/k8s/"), "doc_id", F.lit(".yaml")).alias("path"), text.alias("content"))
    return deployments(files).select("repo", "path", F.col("document").cast("long").alias("document"), "kind", "name", "container", "image", F.array_join("env", ",").alias("env"), F.array_join(F.transform("ports", lambda p: p.cast("string")), ",").alias("ports"))


def deployed_services(spark, folder):
    """Names of services from charts, functions, compose files and image labels, one for each document."""
    docs, kind = table(spark, folder, "documents"), F.col("doc_id") % 4
    name = F.concat(F.lit("svc-"), (F.col("doc_id") % 50).cast("string"))
    path = F.when(kind == 0, "chart/Chart.yaml").when(kind == 1, "serverless.yml").when(kind == 2, "docker-compose.yml").otherwise("Dockerfile")
    text = F.when(kind == 0, F.concat(F.lit("apiVersion: v2\nname: "), name)).when(kind == 1, F.concat(F.lit("service: '"), name, F.lit("'\n"))).when(kind == 2, F.concat(F.lit("services:\n  "), name, F.lit(":\n    image: x\nvolumes:\n  no:\n"))).otherwise(F.concat(F.lit("FROM x\nLABEL service="), name))
    files = docs.select(F.col("source").alias("repo"), F.concat("lang", F.lit("/"), path).alias("path"), text.alias("content"))
    return deployed_as(files).groupBy("repo", "service").agg(F.count("*").alias("files"))


def written_modules(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a Python file of its source's repository, with its text as a remark: it imports from the files of other documents, and calls them."""
    d = table(spark, folder, "documents")
    half, third = (F.floor(F.col("doc_id") / n).cast("string") for n in (2, 3))
    content = F.concat(
        F.lit("# "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n# ")), F.lit("\nfrom .m"), half, F.lit(" import f"), half, F.lit(" as g\nimport pkg.m"), third, F.lit(" as y\ndef f"), F.col("doc_id").cast("string"), F.lit("(x):\n    g(x)\n    y.f"), third,
        F.lit('(y.C.make("g()"))\n    other()\nclass C:\n    def make(self):\n        return self.more()\n    def more(self):\n        f'), F.col("doc_id").cast("string"), F.lit("(1)\n"),
    )
    return d.select(F.coalesce("source", F.lit("none")).alias("repo"), F.format_string("pkg/m%s.py", "doc_id").alias("path"), content.alias("content"))


def resolved_calls(spark, folder):
    return Y.call_edges(written_modules(spark, folder))


def imported_files(spark, folder):
    return Y.import_edges(written_modules(spark, folder))


def pictures(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nations as repositories with a service each, which use the brands of the parts they deliver as topics and their sizes as stores, and call those who order."""
    nation = table(spark, folder, "nation")
    repo, service = F.concat(F.lit("r"), "n_nationkey"), F.concat(F.lit("s"), "n_nationkey")
    none = F.lit(None).cast("string")
    part = table(spark, folder, "part")
    shared = part.select(F.concat(F.lit("t"), "p_brand").alias("id"), F.lit("queue_topic").alias("kind"), F.col("p_brand").alias("name")).unionByName(part.select(F.concat(F.lit("d"), "p_size").alias("id"), F.lit("datastore").alias("kind"), F.col("p_size").cast("string").alias("name"))).distinct()
    entities = nation.select(service.alias("id"), F.lit("service").alias("kind"), F.lower("n_name").alias("name"), F.lit("").alias("key"), repo.alias("repo")).unionByName(shared.select("id", "kind", "name", F.lit("").alias("key"), none.alias("repo")))
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("n"), "l_partkey", "l_orderkey", "l_linenumber")
    uses = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select("n", "p_brand", "p_size", (F.col("l_linenumber") % 2 == 0).alias("even"))
    topics = uses.select("n", F.concat(F.lit("t"), "p_brand").alias("dst"), F.when(F.col("even"), "publishes").otherwise("subscribes").alias("kind"))
    stores = uses.select("n", F.concat(F.lit("d"), "p_size").alias("dst"), F.lit("uses").alias("kind"))
    orders = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").alias("c"))
    calls = lines.join(orders, "l_orderkey").where("n < c and (n * 7 + c) % 3 = 0").select("n", F.concat(F.lit("s"), "c").alias("dst"), F.lit("calls").alias("kind"))
    edges = topics.unionByName(stores).unionByName(calls).distinct().select(F.concat(F.lit("s"), "n").alias("src"), "dst", "kind", F.concat(F.lit("r"), "n").alias("repo"))
    return L.architecture(entities, edges, nation.select(repo.alias("repo"), F.lower("n_name").alias("name")))


def architecture_boxes(spark, folder):
    return pictures(spark, folder)[0]


def architecture_links(spark, folder):
    return pictures(spark, folder)[1]


QUERIES = {f.__name__: f for f in (similar_files, change_feed, token_triage, owned_files, deployed_containers, deployed_services, resolved_calls, imported_files, architecture_boxes, architecture_links)}
_PICTURES = """li AS MATERIALIZED (SELECT s_nationkey AS n, l_partkey, l_orderkey, l_linenumber FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
  e AS MATERIALIZED (SELECT DISTINCT n, 't' || p_brand AS dst, CASE WHEN l_linenumber % 2 = 0 THEN 'publishes' ELSE 'subscribes' END AS kind, 'messaging' AS layer, p_brand AS name FROM li JOIN part ON p_partkey = l_partkey
    UNION ALL SELECT DISTINCT n, 'd' || p_size, 'uses', 'data', CAST(p_size AS VARCHAR) FROM li JOIN part ON p_partkey = l_partkey
    UNION ALL SELECT DISTINCT n, 's' || c_nationkey, 'calls', 'call', '' FROM li JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE n < c_nationkey AND (n * 7 + c_nationkey) % 3 = 0),
  deg AS (SELECT id, count(*) AS size FROM (SELECT 's' || n AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id),
  boxes AS (SELECT 'r' || n_nationkey AS repo, 'core' AS layer, 's' || n_nationkey AS node, 'service' AS kind, lower(n_name) AS name, coalesce(size, 0) AS size FROM nation LEFT JOIN deg ON id = 's' || n_nationkey
    UNION ALL SELECT DISTINCT 'r' || n, layer, dst, CASE layer WHEN 'data' THEN 'datastore' ELSE 'queue_topic' END, name, size FROM e JOIN deg ON id = dst WHERE layer <> 'call'
    UNION ALL SELECT 'r' || n, 'downstream', 'repo:r' || dst[2:], 'repo', lower(n_name), 0 FROM e JOIN nation ON 's' || n_nationkey = dst WHERE layer = 'call'
    UNION ALL SELECT 'r' || dst[2:], 'upstream', 'repo:r' || n, 'repo', lower(n_name), 0 FROM e JOIN nation ON n_nationkey = n WHERE layer = 'call'),
  placed AS (SELECT *, row_number() OVER (PARTITION BY repo, layer ORDER BY size DESC, name, node) AS place, CASE layer WHEN 'core' THEN 9 WHEN 'messaging' THEN 12 WHEN 'data' THEN 10 WHEN 'upstream' THEN 10 ELSE 12 END AS cap FROM boxes),
  kept AS (SELECT * FROM placed WHERE place <= cap)"""
ORACLES = {
    "similar_files": r"""WITH old AS (SELECT source || '/' || doc_id || '.txt' AS path, coalesce(text, '') AS content FROM documents WHERE doc_id % 7 < 3),
  new AS (SELECT 'moved/' || source || '/' || doc_id || '.txt' AS path, coalesce(text, '') || CASE WHEN doc_id % 7 = 1 THEN chr(10) || 'the last line of ' || doc_id ELSE '' END AS content FROM documents WHERE doc_id % 7 IN (1, 2)),
  a AS MATERIALIZED (SELECT path, line, count(*) AS n, strlen(line) + 1 AS bytes FROM (SELECT path, unnest(string_split(content, chr(10))) AS line FROM old) WHERE line <> '' GROUP BY path, line),
  b AS MATERIALIZED (SELECT path, line, count(*) AS n, strlen(line) + 1 AS bytes FROM (SELECT path, unnest(string_split(content, chr(10))) AS line FROM new) WHERE line <> '' GROUP BY path, line),
  ta AS (SELECT path, sum(n * bytes) AS total FROM a GROUP BY path), tb AS (SELECT path, sum(n * bytes) AS total FROM b GROUP BY path),
  shared AS (SELECT a.path AS old_path, b.path AS path, sum(least(a.n, b.n) * a.bytes) AS s FROM a JOIN b ON a.line = b.line GROUP BY 1, 2)
SELECT old_path, s.path, CAST(100 * s // greatest(ta.total, tb.total) AS INT) AS similarity FROM shared s JOIN ta ON ta.path = old_path JOIN tb ON tb.path = s.path WHERE 100 * s // greatest(ta.total, tb.total) >= 50""",
    "token_triage": """WITH f AS (SELECT CASE WHEN doc_id % 4 = 1 THEN 'changed' WHEN doc_id % 3 = 0 AND doc_id % 100 >= 90 THEN 'renamed' WHEN doc_id % 3 = 0 THEN 'moved' ELSE 'same tokens' END AS reason FROM documents)
SELECT CASE WHEN reason IN ('changed', 'moved') THEN 'proceed' ELSE 'abort' END AS verdict, reason, count(*) AS files FROM f GROUP BY 1, 2""",
    "owned_files": """WITH f AS (SELECT source AS repo, doc_id % 8 AS k, (['', 'src/', 'src/api/test_', 'docs/', 'docs/internal/', 'web/', 'lib/a/', 'src/'])[doc_id % 8 + 1] || doc_id || (['.md', '.go', '.py', '.md', '.md', '.js', '.c', '.js'])[doc_id % 8 + 1] AS path FROM documents)
SELECT repo, path, (['@acme/' || repo, '@acme/' || repo, '@test', '@docs @acme/' || repo, '', '@web', '@lib', '@web'])[k + 1] AS owners, (['*', '*', '/src/**/test_*.py', '/docs/', '/docs/internal/', '*.js', 'lib', '*.js'])[k + 1] AS pattern, CAST(([2, 2, 6, 4, 7, 3, 8, 3])[k + 1] AS BIGINT) AS line FROM f""",
    "deployed_containers": """SELECT source AS repo, 'deploy/k8s/' || doc_id || '.yaml' AS path, CAST(0 AS BIGINT) AS document, 'Deployment' AS kind, 'svc-' || doc_id AS name, 'main' AS container, 'acme/' || source || ':' || n_chars AS image, 'LANG_' || lang || ',MODE' AS env, CAST(doc_id % 9000 + 1000 AS VARCHAR) AS ports FROM documents""",
    "deployed_services": """SELECT repo, service, count(*) AS files FROM (SELECT DISTINCT source AS repo, 'svc-' || doc_id % 50 AS service, lang, doc_id % 4 AS k FROM documents) GROUP BY 1, 2""",
    "resolved_calls": """WITH d AS (SELECT coalesce(source, 'none') AS repo, doc_id, coalesce(length(text) - length(replace(text, chr(10), '')), 0) AS n, doc_id // 2 AS k, doc_id // 3 AS j FROM documents),
  c AS (SELECT repo, doc_id, 'f' || doc_id AS symbol, 'g' AS callee, n + 5 AS line, k AS t, 'f' || k AS meant FROM d UNION ALL SELECT repo, doc_id, 'f' || doc_id, 'y.f' || j, n + 6, j, 'f' || j FROM d
    UNION ALL SELECT repo, doc_id, 'f' || doc_id, 'y.C.make', n + 6, j, 'C.make' FROM d UNION ALL SELECT repo, doc_id, 'f' || doc_id, 'other', n + 7, NULL, NULL FROM d),
  r AS (SELECT c.repo, 'pkg/m' || c.doc_id || '.py' AS path, symbol, callee, line, CASE WHEN d.doc_id IS NOT NULL THEN 'import' END AS how, 'pkg/m' || d.doc_id || '.py' AS to_path, CASE WHEN d.doc_id IS NOT NULL THEN meant END AS to_symbol FROM c LEFT JOIN d ON d.repo = c.repo AND d.doc_id = c.t
    UNION ALL SELECT repo, 'pkg/m' || doc_id || '.py', 'C.make', 'self.more', n + 10, 'file', 'pkg/m' || doc_id || '.py', 'C.more' FROM d UNION ALL SELECT repo, 'pkg/m' || doc_id || '.py', 'C.more', 'f' || doc_id, n + 12, 'file', 'pkg/m' || doc_id || '.py', 'f' || doc_id FROM d)
SELECT repo, path, symbol, callee, CAST(line AS BIGINT) AS line, how, to_path, to_symbol FROM r WHERE NOT coalesce(path = to_path AND symbol = to_symbol, false)""",
    "imported_files": """WITH d AS (SELECT coalesce(source, 'none') AS repo, doc_id FROM documents), i AS (SELECT repo, doc_id, doc_id // 2 AS t FROM d UNION SELECT repo, doc_id, doc_id // 3 FROM d)
SELECT i.repo, 'pkg/m' || i.doc_id || '.py' AS path, 'pkg/m' || t AS to_unit FROM i JOIN d ON d.repo = i.repo AND d.doc_id = t WHERE t <> i.doc_id""",
    "architecture_boxes": f"""WITH {_PICTURES} SELECT repo, layer, CAST(place AS INT) AS place, node, kind, name, CAST(size AS BIGINT) AS size FROM kept
  UNION ALL SELECT repo, layer, CAST(cap + 1 AS INT), 'others:' || layer, 'others', 'others', count(*) FROM placed WHERE place > cap GROUP BY repo, layer, cap""",
    "architecture_links": f"""WITH {_PICTURES}, l AS (SELECT 'r' || n AS repo, CASE kind WHEN 'subscribes' THEN dst ELSE 's' || n END AS src, CASE kind WHEN 'subscribes' THEN 's' || n WHEN 'calls' THEN 'repo:r' || dst[2:] ELSE dst END AS dst, kind FROM e
    UNION ALL SELECT 'r' || dst[2:], 'repo:r' || n, dst, kind FROM e WHERE kind = 'calls')
SELECT l.repo, src, l.dst, l.kind, count(*) AS weight FROM l WHERE EXISTS (SELECT 1 FROM kept k WHERE k.repo = l.repo AND k.node = src) AND EXISTS (SELECT 1 FROM kept k WHERE k.repo = l.repo AND k.node = l.dst) GROUP BY ALL""",
}
