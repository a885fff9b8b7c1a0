"""The queries of the corpus operators over a data folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from .automata import substring_dedup
from .byte_bpe import byte_bpe
from .jaccard import similarity_classes
from .mixing import mixing
from .multi_index import neighbours
from .periodic_runs import planted_runs
from .phrases import phrases
from .pieces import checked_pieces
from .pii import personal_data
from .prefix_free import suffix_dedup
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .secrets import secret_scan


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_groups(spark: SparkSession, folder: str) -> DataFrame:
    return similarity_classes(table(spark, folder, "documents"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"))


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier(table(spark, folder, "documents"), table(spark, folder, "labels"))


def removed_units(removed: Column) -> Column:
    return F.aggregate(removed, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", removed_units(F.col("removed")).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup(table(spark, folder, "documents"))
    return out.select("doc_id", "n_bytes", removed_units(F.col("removed")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours(table(spark, folder, "embeddings"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan(table(spark, folder, "documents"))


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing(table(spark, folder, "documents"))


def op3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return checked_pieces(table(spark, folder, "documents"))


def op10_pii(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe(table(spark, folder, "documents"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return planted_runs(table(spark, folder, "documents"))


def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_groups": op1_token_groups,
    "op2_quality_rules": op2_quality_rules,
    "op3_pieces": op3_pieces,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_multi_index": op5_multi_index,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_secrets": op7_secrets,
    "op8_mixing": op8_mixing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pii": op10_pii,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrases": op13_phrases,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op1_token_groups": r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS token FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.token = y.token AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
  reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(b) FROM reach WHERE reach.a = w.doc_id) AS component_id, (SELECT count(*) FROM links WHERE links.a = w.doc_id) AS n_links FROM w LEFT JOIN n ON n.doc_id = w.doc_id""",
    "op4_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
  starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos0 FROM w WHERE len(words) >= 13),
  windows AS (SELECT doc_id, pos0, list_slice(words, pos0, pos0 + 12) AS win FROM starts),
  firsts AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
  bad AS (SELECT doc_id, pos0 FROM windows JOIN firsts USING (win) WHERE least < doc_id),
  gone AS (SELECT DISTINCT doc_id, pos0 + unnest(range(0, 13)) AS pos FROM bad),
  lost AS (SELECT doc_id, list(pos) AS pos FROM gone GROUP BY doc_id),
  kept AS (SELECT w.doc_id, len(words) AS n_words, coalesce(len(pos), 0) AS n_removed, CASE WHEN pos IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(pos, i)) END AS stay FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept""",
    "op12_periodic_runs": r"""
WITH bits AS (SELECT doc_id, flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]) AS steps FROM documents WHERE doc_id IS NOT NULL),
  crc AS (SELECT DISTINCT doc_id, xor(list_reduce([CAST(s AS BIGINT) FOR s IN steps], lambda c, s: CASE WHEN s >= 0 THEN xor(c, s) ELSE xor(c >> 1, (c & 1) * 3988292384) END, CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM bits),
  w AS (SELECT d.doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, h, h // 10 AS g FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id),
  p AS (SELECT *, CAST(len(words) AS BIGINT) AS n, g % len(words) AS a, 1 + (len(words) - g % len(words)) // (3 + g % 8) AS p FROM w),
  x AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END] FOR i IN range(n)] ELSE words END AS words FROM p),
  six AS MATERIALIZED (SELECT id, i, array_to_string(words[i + 1 : i + 6], ' ') AS s FROM (SELECT id, words, unnest(range(0, n - 5)) AS i FROM x WHERE n >= 12)),
  pairs AS (SELECT l.id, l.i, r.i - l.i AS q FROM six l JOIN six r ON l.id = r.id AND l.s = r.s AND l.i < r.i),
  stretches AS (SELECT id, q, min(i) AS start, count(*) + 5 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM pairs) GROUP BY id, q, island),
  runs AS MATERIALIZED (SELECT id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(12, 2 * q) GROUP BY id, start, length),
  listed AS (SELECT id, count(*) AS n_runs, first(struct_pack(start := start, length := length, period := period) ORDER BY length DESC, start, period) AS best, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM runs GROUP BY id),
  ends AS (SELECT id, start + period AS first_gone, max(start + length) AS stop FROM runs GROUP BY id, start + period),
  gone AS (SELECT id, list(DISTINCT k) AS ks FROM (SELECT id, unnest(range(first_gone, stop)) AS k FROM ends) GROUP BY id),
  kept AS (SELECT id, string_agg(word, ' ' ORDER BY k) AS text FROM (SELECT x.id, unnest(words) AS word, unnest(range(n)) AS k FROM x JOIN gone ON gone.id = x.id) AS all_words WHERE NOT EXISTS (SELECT 1 FROM (SELECT id AS gid, unnest(ks) AS gk FROM gone) AS g WHERE gid = all_words.id AND gk = k) GROUP BY id)
SELECT x.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS "start", CAST(best.length AS BIGINT) AS "length", CAST(best.period AS BIGINT) AS "period", CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(CASE WHEN gone.id IS NULL THEN array_to_string(words, ' ') ELSE coalesce(kept.text, '') END) AS collapsed_sha256
FROM x LEFT JOIN listed ON listed.id = x.id LEFT JOIN gone ON gone.id = x.id LEFT JOIN kept ON kept.id = x.id""",
    "op13_phrases": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
  grams AS (SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(words) >= m)),
  f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
  totals AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
  parts AS (SELECT lang, phrase, a, m, string_split(phrase, ' ') AS words FROM f WHERE m >= 2),
  cuts AS (SELECT lang, phrase, a, k, array_to_string(words[1 : k], ' ') AS left_part, array_to_string(words[k + 1 :], ' ') AS right_part FROM (SELECT *, unnest(range(1, m)) AS k FROM parts)),
  scored AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = left_part JOIN f y ON y.lang = c.lang AND y.phrase = right_part),
  loosest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
  inner_parts AS (SELECT lang, a, array_to_string(words[s : s + size - 1], ' ') AS phrase FROM (SELECT lang, a, words, size, unnest(range(1, m - size + 2)) AS s FROM (SELECT *, unnest(range(2, m)) AS size FROM parts))),
  most AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY lang, phrase),
  kept AS (SELECT l.* FROM loosest l LEFT JOIN most t ON t.lang = l.lang AND t.phrase = l.phrase WHERE most IS NULL OR 100 * most < 80 * a),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place FROM kept)
SELECT r.lang, CAST(place AS BIGINT) AS "rank", phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score FROM ranked r JOIN totals ON totals.lang = r.lang WHERE place <= 2000""",
}
