"""Markup, sections, frames, signatures and indexes whose results are known: documents and events give what varies in them."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from millrace.functions.text import hmac_sha256, top_frames
from millrace.operators import retrieval as R
from millrace.operators.system import VersionedIndex
from millrace.session import shared_folder, table
from millrace.sources.documents import markdown_chunks
from millrace.sources.markup import adf_markdown, storage_markdown


def said(text: str) -> Column:
    """A text with columns in it, in braces."""
    parts = text.replace("}", "{").split("{")
    return F.concat(*(F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p))


def wiki_pages(spark, folder):
    """A page of each document in wiki storage XML, as Markdown."""
    xml = said('<h2>Run {source} &amp; fix</h2><p>Doc <strong>{doc_id}</strong> in <em>{lang}</em> or <code>{n_chars}</code>.</p><ul><li>one<ul><li>{source}</li></ul></li><li>two</li></ul>')
    code = said('<ac:structured-macro ac:name="code"><ac:parameter ac:name="language">py</ac:parameter><ac:plain-text-body><![CDATA[if {doc_id} < b:\n    go()]]></ac:plain-text-body></ac:structured-macro>')
    grid = said("<table><tbody><tr><th>k</th><th>v|w</th></tr><tr><td><p>{n_chars}</p></td><td>{lang}</td></tr></tbody></table>")
    return table(spark, folder, "documents").select("doc_id", storage_markdown(F.concat(xml, code, F.when(F.col("doc_id") % 2 == 0, grid).otherwise(""))).alias("markdown"))


def tracker_pages(spark, folder):
    """An issue of each document in ADF, as Markdown."""
    quote = F.lit('"')
    text = lambda column: F.concat(F.lit('{"type": "text", "text": '), quote, F.col(column).cast("string"), quote, F.lit("}"))
    item = lambda *k: F.concat(F.lit('{"type": "listItem", "content": [{"type": "paragraph", "content": ['), *k, F.lit("]}]}"))
    adf = F.concat(F.lit('{"type": "doc", "content": [{"type": "heading", "attrs": {"level": 3}, "content": ['), text("source"), F.lit(']}, {"type": "orderedList", "content": ['), item(text("lang")), F.lit(", "), item(text("n_chars")), F.lit(']}, {"type": "codeBlock", "attrs": {"language": "go"}, "content": ['), text("doc_id"), F.lit("]}]}"))
    return table(spark, folder, "documents").select("doc_id", adf_markdown(adf).alias("markdown"))


def markdown_sections(spark, folder):
    """Sections of a Markdown page of each document: what comes first, a section, one below it, and one of the same name."""
    page = said("# Title\nabout {source}\n\n## Set up\n\nsteps {n_chars}\n```\n## no heading\n```\n\n### Deep *dive*\n\nmore in {lang}\n\n## Set up ##\n\nagain {doc_id}\n")
    docs = table(spark, folder, "documents").select("doc_id", page.alias("text"))
    return markdown_chunks(docs, keep=["doc_id"])


def stack_frames(spark, folder):
    """The top frames of a stack for each event: those of the application if there are any."""
    own = F.col("event_id") % 3 != 0
    frame = lambda module, function, file, inside: F.struct(module.cast("string").alias("module"), function.cast("string").alias("function"), file.cast("string").alias("file"), inside.alias("in_app"))
    stack = F.array(
        frame(F.lit("Lib.Core"), F.lit("Run"), F.lit(None), F.lit(False)), frame(F.lit(""), F.col("event_type"), F.lit("Src/Main.py"), own), frame(F.lit(None), F.lit(None), F.lit(None), own),
        *(frame(F.col("user_id"), F.lit(f"F{i}"), F.lit(None), own) for i in range(6)),
    )
    return table(spark, folder, "events").select("event_id", F.array_join(top_frames(stack), "|").alias("frames"))


def signed_deliveries(spark, folder):
    """Signatures of the texts of all documents, with keys short and long."""
    key = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.repeat(F.col("source"), 20))
    return table(spark, folder, "documents").select("doc_id", hmac_sha256(key, F.coalesce("text", F.lit(""))).alias("signature"))


def expanded_chunks(spark, folder):
    """What the best five chunks of each question call or are called by."""
    docs = table(spark, folder, "documents")
    query = F.col("doc_id") % 37
    ranked = docs.select(query.alias("query_id"), F.row_number().over(Window.partitionBy(query).orderBy(F.col("n_chars") % 101, "doc_id")).alias("rank"), F.col("doc_id").alias("chunk_id")).where("rank <= 20")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("k"), "doc_id")).alias("key"))
    calls = docs.select(F.concat(F.lit("k"), "doc_id").alias("src"), F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") + 7, F.col("doc_id") - F.col("doc_id") % 10)).alias("to")).select("src", F.concat(F.lit("k"), "to").alias("dst"))
    return R.expanded(ranked, chunks, calls.where("src <> dst"))


def reindexed(spark, folder):
    """An index that is built anew while rows come in: what readers see after the swap, and how many rows they saw before it."""
    docs = table(spark, folder, "documents").select("doc_id", "source")
    index = VersionedIndex(spark, shared_folder(spark, "index"))
    index.swap(index.build(docs.where("doc_id % 3 = 0").withColumn("model", F.lit("old"))))
    pending = index.build(docs.where("doc_id % 3 < 2").withColumn("model", F.lit("new")))
    index.add(docs.where("doc_id % 3 = 2").withColumn("model", F.lit("added")), pending)
    before = index.read().groupBy("model").agg(F.count("*").alias("documents")).withColumn("seen", F.lit("before"))
    index.swap(pending)
    return before.unionByName(index.read().groupBy("model").agg(F.count("*").alias("documents")).withColumn("seen", F.lit("after")))


QUERIES = {f.__name__: f for f in (wiki_pages, tracker_pages, markdown_sections, stack_frames, signed_deliveries, expanded_chunks, reindexed)}
ORACLES = {
    "wiki_pages": """SELECT doc_id, '## Run ' || source || ' & fix' || n || n || 'Doc **' || doc_id || '** in *' || lang || '* or `' || n_chars || '`.' || n || n || '- one' || n || '  - ' || source || n || '- two' || n || n || '```py' || n || 'if ' || doc_id || ' < b:' || n || '    go()' || n || '```'
  || CASE WHEN doc_id % 2 = 0 THEN n || n || '| k | v\\|w |' || n || '| --- | --- |' || n || '| ' || n_chars || ' | ' || lang || ' |' ELSE '' END AS markdown FROM documents, (SELECT chr(10) AS n)""",
    "tracker_pages": "SELECT doc_id, '### ' || source || n || n || '1. ' || lang || n || '2. ' || n_chars || n || n || '```go' || n || doc_id || n || '```' AS markdown FROM documents, (SELECT chr(10) AS n)",
    "markdown_sections": """SELECT doc_id, s.symbol, replace(s.content, '~', chr(10)) AS content, CAST(s.a AS INT) AS start_line, CAST(s.b AS INT) AS end_line FROM (SELECT doc_id, unnest([
  {'symbol': '__intro__', 'content': '# Title~about ' || source, 'a': 1, 'b': 3}, {'symbol': 'set-up', 'content': '## Set up~~steps ' || n_chars || '~```~## no heading~```', 'a': 4, 'b': 10},
  {'symbol': 'set-up/deep-dive', 'content': '### Deep *dive*~~more in ' || lang, 'a': 11, 'b': 14}, {'symbol': 'set-up#2', 'content': '## Set up ##~~again ' || doc_id, 'a': 15, 'b': 18}]) AS s FROM documents)""",
    "stack_frames": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'lib.core:run|src/main.py:' || event_type || '|' || user_id || ':f0|' || user_id || ':f1|' || user_id || ':f2' ELSE 'src/main.py:' || event_type || '|' || user_id || ':f0|' || user_id || ':f1|' || user_id || ':f2|' || user_id || ':f3' END AS frames FROM events",
    "signed_deliveries": """WITH k AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 2 = 0 THEN hex(encode(source)) WHEN strlen(source) * 20 > 64 THEN sha256(repeat(source, 20)) ELSE hex(encode(repeat(source, 20))) END AS h FROM documents),
  b AS (SELECT doc_id, text, [CAST('0x' || substr(rpad(h, 128, '0'), 2 * i - 1, 2) AS INT) FOR i IN range(1, 65)] AS codes FROM k),
  p AS (SELECT doc_id, text, from_hex(array_to_string([printf('%02x', xor(c, 54)) FOR c IN codes], '')) AS inside, from_hex(array_to_string([printf('%02x', xor(c, 92)) FOR c IN codes], '')) AS outside FROM b)
SELECT doc_id, sha256(outside || from_hex(sha256(inside || encode(text)))) AS signature FROM p""",
    "expanded_chunks": """WITH r AS (SELECT doc_id % 37 AS q, row_number() OVER (PARTITION BY doc_id % 37 ORDER BY n_chars % 101, doc_id) AS rank, doc_id AS id FROM documents QUALIFY rank <= 20),
  a AS (SELECT q, id FROM r WHERE id % 4 > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY rank, id) <= 5),
  c AS (SELECT doc_id AS s, unnest([doc_id * 2, doc_id + 7, doc_id - doc_id % 10]) AS d FROM documents), e AS (SELECT s, d FROM c WHERE s <> d UNION SELECT d, s FROM c WHERE s <> d),
  n AS (SELECT DISTINCT q, d FROM a JOIN e ON e.s = a.id WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.q = a.q AND b.id = e.d)),
  f AS (SELECT q, d, row_number() OVER (PARTITION BY q ORDER BY 'k' || d) AS place FROM n QUALIFY place <= 10)
SELECT q AS query_id, CAST(place AS INT) AS place, d AS chunk_id FROM f WHERE d % 4 > 0 AND d IN (SELECT doc_id FROM documents) AND NOT EXISTS (SELECT 1 FROM r WHERE r.q = f.q AND r.id = f.d)""",
    "reindexed": """WITH d AS (SELECT doc_id % 3 AS k, count(*) AS documents FROM documents GROUP BY 1) SELECT 'old' AS model, documents, 'before' AS seen FROM d WHERE k = 0 UNION ALL SELECT 'added', documents, 'before' FROM d WHERE k = 2
  UNION ALL SELECT 'new', CAST(sum(documents) AS BIGINT), 'after' FROM d WHERE k < 2 UNION ALL SELECT 'added', documents, 'after' FROM d WHERE k = 2""",
}
