"""Knowledge snapshots, bounded walks, replaced sources and decode contexts. Documents, customers and embeddings stand in for pages, repositories and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import changes as C
from millrace.operators import graph as G
from millrace.operators import knowledge as K
from millrace.plans.graph import EDGES_SQL, ENTITIES_SQL, edges, entities, starts
from millrace.session import table
from millrace.streaming.signals import made_safe


def pages(spark, folder):
    d = table(spark, folder, "documents")
    return d.select(F.col("source").alias("stream"), F.col("doc_id").alias("id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, n_chars % 500)").alias("updated_at"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("Known-Issue"), F.col("lang"))).otherwise(F.array("lang")).alias("labels"))


def changed_pages(spark, folder):
    """Pages of one stream that changed since its cursor, in order of change."""
    return K.changed(pages(spark, folder), "src1", F.lit("2024-01-06 00:00:00").cast("timestamp_ntz")).select("id", "updated_at")


def knowledge_cursors(spark, folder):
    """Every stream's cursor after its changed pages; cursors never go back, and a new stream gets one."""
    p = pages(spark, folder)
    cursors = p.select("stream").distinct().where("stream <> 'src2'").select("stream", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz").alias("cursor"))
    return K.next_cursor(p.where("floor(id / 20) % 3 = 0"), cursors)


def pages_gone(spark, folder):
    """Stored pages that a full list no longer has; streams that were not listed lose none."""
    p = pages(spark, folder)
    return K.gone(p, p.where("stream <> 'src3' AND floor(id / 20) % 4 <> 0").select("stream", "id"))


def labelled_pages(spark, folder):
    return K.labelled(pages(spark, folder), "KNOWN-issue").select("id", "stream")


def bounded_neighbourhoods(spark, folder):
    """Walks of two steps among entities that a reader may see, 20 nodes of each start at most, as the operator bounds them."""
    ent = entities(spark, folder).withColumn("repo_id", F.col("owner"))
    return G.bounded_neighbourhood(edges(spark, folder), ent, starts(spark, folder), 2, F.col("repo_id").isNull() | ~F.col("repo_id").endswith("7"), 20)


def replaced_edges(spark, folder):
    """The graph after some files were read again."""
    e = edges(spark, folder).withColumn("source_path", F.regexp_replace("src", "[0-9]$", ""))
    fresh = e.where("source_path like '%1' AND kind <> 'subscribes'").withColumn("kind", F.upper("kind"))
    return C.replaced_sources(e, fresh, e.where("source_path like '%1'")).groupBy("kind").agg(F.count("*").alias("edges"))


def retired_entities(spark, folder):
    """Entities of repositories that no edge names once the owning edges are gone."""
    e = edges(spark, folder).where("kind <> 'owns'")
    return C.unreferenced(entities(spark, folder).withColumn("repo_id", F.col("owner")), e).select("id")


def decode_contexts(spark, folder):
    """What explains every fiftieth vector's issue: chunks of its frames, near code, similar issues and runbooks."""
    v = table(spark, folder, "embeddings")
    source = F.when(F.col("vec_id") % 5 == 1, "issue_decode").when(F.col("vec_id") % 5 == 2, "confluence").otherwise("code")
    # decodes and runbooks lie near the issue of their fifty, more or less
    like = v.select((F.col("vec_id")).alias("like"), F.col("embedding").alias("other")).where("like % 50 = 0")
    share = F.when(F.col("vec_id") % 5 == 1, F.lit(3.0)).when(F.col("vec_id") % 5 == 2, F.lit(2.0)).otherwise(F.lit(0.0))
    near = F.zip_with("embedding", "other", lambda x, y: share * y.cast("double") + x.cast("double"))
    mixed = v.withColumn("like", F.col("vec_id") - F.col("vec_id") % 50).join(like, "like").withColumn("embedding", near)
    chunks = mixed.select(F.col("vec_id").alias("chunk_id"), source.alias("source"), F.concat(F.lit("src/m"), (F.col("vec_id") % 400).cast("string"), F.lit(".py")).alias("path"), F.lit("run").alias("symbol"), F.col("embedding").alias("vector"), (F.col("vec_id") - 1).alias("owner"))
    issues = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("issue"), F.col("embedding").alias("vector"))
    frames = issues.select("issue", F.lit(1).alias("place"), F.concat(F.lit("/app/src/m"), ((F.col("issue") + 3) % 400).cast("string"), F.lit(".py")).alias("file"), F.lit("run").alias("function"))
    return K.decode_context(issues, frames, chunks)


def safe_events(spark, folder):
    """Events as they are stored: defaults, secrets scrubbed, environment, service and an id of their own."""
    e = table(spark, folder, "events")
    none = F.lit(None).cast("string")
    raw = e.select("event_id", F.when(F.col("event_id") % 50 == 0, F.lit(" ")).otherwise(F.lit("Sentry")).alias("source"), F.when(F.col("event_id") % 3 == 0, F.lit("alert")).alias("kind"), none.alias("severity"), F.lit("").alias("title"), F.concat(F.lit("token=abcdefghijklmnop123 of user "), F.col("user_id").cast("string"), F.lit("\nmore")).alias("message"), none.alias("exception_type"), F.create_map(F.lit("env"), F.lit("PROD "), F.lit("app"), F.col("event_type")).alias("attrs"), none.alias("environment"), F.lit("unknown").alias("service"), none.alias("external_id"), F.col("ts").alias("received_at"), (F.col("ts") + F.when(F.col("event_id") % 2 == 0, F.expr("interval 1 hour")).otherwise(F.expr("interval 1 minute"))).alias("occurred_at"))
    out = made_safe(raw)
    return out.groupBy("source", "kind", "severity", "environment", "service", (F.col("occurred_at") == F.col("received_at")).alias("clamped"), F.col("external_id").startswith("h:").alias("own_id"), F.col("message").contains("abcdefghijklmnop123").alias("leaks"), (F.col("title") != "").alias("titled")).agg(F.count("*").alias("events"), F.countDistinct("external_id").alias("ids"))


QUERIES = {f.__name__: f for f in (changed_pages, knowledge_cursors, pages_gone, labelled_pages, bounded_neighbourhoods, replaced_edges, retired_entities, decode_contexts, safe_events)}
_P = "p AS (SELECT source AS stream, doc_id AS id, TIMESTAMP '2024-01-01' + to_hours(CAST(n_chars % 500 AS INT)) AS updated_at FROM documents)"
_COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
ORACLES = {
    "changed_pages": f"WITH {_P} SELECT id, updated_at FROM p WHERE stream = 'src1' AND updated_at > TIMESTAMP '2024-01-06' ORDER BY updated_at, id",
    "knowledge_cursors": f"WITH {_P} SELECT stream, greatest(CASE WHEN stream <> 'src2' THEN TIMESTAMP '2024-01-20' END, max(updated_at) FILTER (WHERE (id // 20) % 3 = 0)) AS cursor FROM p GROUP BY stream HAVING stream <> 'src2' OR count(*) FILTER (WHERE (id // 20) % 3 = 0) > 0",
    "pages_gone": f"WITH {_P} SELECT stream, id FROM p WHERE stream <> 'src3' AND (id // 20) % 4 = 0 AND stream IN (SELECT stream FROM p WHERE (id // 20) % 4 <> 0)",
    "labelled_pages": "SELECT doc_id AS id, source AS stream FROM documents WHERE doc_id % 5 = 0",
    "bounded_neighbourhoods": f"""WITH {ENTITIES_SQL}, {EDGES_SQL}, ok AS (SELECT id FROM ent WHERE owner IS NULL OR owner NOT LIKE '%7'), e AS (SELECT src, dst FROM edge WHERE src IN (SELECT id FROM ok) AND dst IN (SELECT id FROM ok)), s AS (SELECT src AS node, dst AS other FROM e UNION SELECT dst, src FROM e),
  z AS (SELECT 'c:' || c_custkey AS start FROM customer WHERE c_custkey % 50 = 0), one AS (SELECT start, other AS node, row_number() OVER (PARTITION BY start ORDER BY other) AS n FROM z JOIN s ON node = start), a AS (SELECT start, start AS node, 0 AS distance FROM z UNION ALL SELECT start, node, 1 FROM one WHERE n <= 19),
  two AS (SELECT DISTINCT a.start, other AS node FROM a JOIN s ON s.node = a.node WHERE distance = 1 AND NOT EXISTS (SELECT 1 FROM a b WHERE b.start = a.start AND b.node = other)), u AS (SELECT * FROM a UNION ALL SELECT start, node, 2 FROM two)
SELECT start, node, distance FROM u QUALIFY row_number() OVER (PARTITION BY start ORDER BY distance, node) <= 20""",
    "replaced_edges": f"""WITH {EDGES_SQL}, e AS (SELECT *, regexp_replace(src, '[0-9]$', '') AS p FROM edge) SELECT kind, count(*) AS edges FROM e WHERE p NOT LIKE '%1' GROUP BY 1 UNION ALL SELECT upper(kind), count(*) FROM (SELECT DISTINCT * FROM e WHERE p LIKE '%1' AND kind <> 'subscribes') GROUP BY 1""",
    "retired_entities": f"WITH {ENTITIES_SQL}, {EDGES_SQL}, n AS (SELECT src AS id FROM edge WHERE kind <> 'owns' UNION SELECT dst FROM edge WHERE kind <> 'owns') SELECT id FROM ent WHERE owner IS NOT NULL AND id NOT IN (SELECT id FROM n)",
    "decode_contexts": f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  v AS (SELECT x.id, [(CASE x.id % 5 WHEN 1 THEN CAST(3 AS DOUBLE) WHEN 2 THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) * y.v[i] + x.v[i] FOR i IN range(1, len(x.v) + 1)] AS v, CASE x.id % 5 WHEN 1 THEN 'issue_decode' WHEN 2 THEN 'confluence' ELSE 'code' END AS source FROM e x JOIN e y ON y.id = x.id - x.id % 50),
  s AS (SELECT a.id AS issue, b.id AS chunk_id, b.source, {_COS} AS score FROM v a, v b WHERE a.id % 50 = 0),
  n AS (SELECT *, row_number() OVER (PARTITION BY issue, source ORDER BY score DESC, chunk_id) AS r FROM s),
  f AS (SELECT a.id AS issue, min(b.id) AS chunk_id FROM v a JOIN v b ON b.id % 400 = (a.id + 3) % 400 AND b.source = 'code' WHERE a.id % 50 = 0 AND length('src/m' || (b.id % 400) || '.py') > 0 GROUP BY 1),
  c AS (SELECT issue, chunk_id, 0 AS late, 1 AS place FROM f UNION ALL SELECT issue, chunk_id, 1, r FROM n WHERE source = 'code' AND r <= 8), g AS (SELECT issue, chunk_id, min(late * 100 + place) AS spot FROM c GROUP BY 1, 2),
  k AS (SELECT issue, chunk_id, row_number() OVER (PARTITION BY issue ORDER BY spot, chunk_id) AS place FROM g),
  i AS (SELECT issue, chunk_id, row_number() OVER (PARTITION BY issue ORDER BY r) AS place FROM n WHERE source = 'issue_decode' AND r <= 4 AND score >= 0.85 AND chunk_id - 1 <> issue)
SELECT issue, 'code' AS part, CAST(place AS INT) AS place, chunk_id FROM k WHERE place <= 8 UNION ALL SELECT issue, 'similar', CAST(place AS INT), chunk_id FROM i WHERE place <= 3 UNION ALL SELECT issue, 'runbook', CAST(r AS INT), chunk_id FROM n WHERE source = 'confluence' AND r <= 2 AND score >= 0.75""",
    "safe_events": """SELECT 'sentry' AS source, CASE WHEN event_id % 3 = 0 THEN 'alert' ELSE 'error' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'warning' ELSE 'error' END AS severity, 'prod' AS environment, event_type AS service, event_id % 2 = 0 AS clamped, true AS own_id, false AS leaks, true AS titled, count(*) AS events,
  count(DISTINCT (user_id, CASE WHEN event_id % 2 = 0 THEN ts ELSE ts + INTERVAL 1 MINUTE END)) AS ids FROM events WHERE event_id % 50 <> 0 GROUP BY ALL""",
}
