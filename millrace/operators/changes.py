"""Change data: snapshots compared, folded and swapped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.lexer import significant_key
from millrace.functions.text import path_pattern
from millrace.functions.versions import dependencies, major_bumps


def supersedes(incoming: Column, existing: Column) -> Column:
    """An imported document never overwrites a generated one."""
    return ~((incoming == "imported_doc") & (existing == "generated_doc"))


def manifest_diff(stored: DataFrame, fresh: DataFrame, affected: DataFrame) -> DataFrame:
    """id and change (added, changed, removed, revived, unchanged, skipped) between two sets of chunks.

    stored: id, path, source, hash, live. fresh: id, path, source, hash, ordinal (the first of equal ids counts). Only live
    chunks on affected paths can be removed. An id that comes back with other content is added, not changed.
    """
    fresh = fresh.groupBy("id").agg(F.min_by(F.struct("source", "hash"), "ordinal").alias("new"))
    old = stored.select("id", F.struct("path", "source", "hash", "live").alias("old"))
    touched = affected.select(F.col("path").alias("touched")).distinct()
    both = old.join(fresh, "id", "full").join(touched, F.col("old.path") == F.col("touched"), "left")
    live = F.col("old.live")
    change = (
        F.when(F.col("new").isNull(), F.when(live & F.col("touched").isNotNull(), "removed"))
        .when(F.col("old").isNull(), "added")
        .when(~supersedes(F.col("new.source"), F.col("old.source")), "skipped")
        .when(~live & (F.col("old.hash") == F.col("new.hash")), "revived")
        .when(~live, "added")
        .when((F.col("old.hash") != F.col("new.hash")) | (F.col("old.source") != F.col("new.source")), "changed")
        .otherwise("unchanged")
    )
    return both.select("id", change.alias("change")).where("change IS NOT NULL")


def missing(stored: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of stored whose keys the live snapshot has no more."""
    return stored.join(live.select(*keys).distinct(), keys, "left_anti")


def upserted(table: DataFrame, delta: DataFrame, keys: list[str], order: str) -> DataFrame:
    """table with delta's rows in place of those with the same keys; of several the last by order, and of those that tie the one with the greatest values."""
    both = table.withColumn("__from", F.lit(0)).unionByName(delta.withColumn("__from", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    ordered = [c for c, kind in table.dtypes if c in rest and "map<" not in kind and "variant" not in kind]  # maps and variants have no order
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__from", order, *ordered)).alias("row"))
    return last.select(*keys, "row.*").select(*table.columns)


def rekeyed(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """rows with copies under new ids (renames: old, new); what is stored under a new id already stays."""
    copies = rows.join(F.broadcast(renames), rows.id == renames.old).select(renames.new.alias("id"), *[c for c in rows.columns if c != "id"])
    return rows.unionByName(copies.join(rows.select("id"), "id", "left_anti").select(*rows.columns))


def graph_difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of either graph that the other lacks, with change (added or removed)."""
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))


def content_key(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A hash of each key's rows whatever their order, to replace them only if they changed."""
    return rows.groupBy(key).agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(F.concat_ws("\x1f", *columns)))), 256).alias("content"))


def replaced_sources(edges: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """edges with all that some source files (source_path) gave replaced by what they give now. edges, fresh: src, kind, dst, source_path."""
    return edges.join(sources.select("source_path").distinct(), "source_path", "left_anti").select(*fresh.columns).unionByName(fresh.distinct())


def unreferenced(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Repository entities (id, repo_id) that no edge names any more: to be retired."""
    named = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return entities.where("repo_id IS NOT NULL").join(named, "id", "left_anti")


#: Paths that never need documents: fixed values.
DOC_PATHS = r"^(?:docs|documentation)/"


def triage(files: DataFrame, ignore: list[str]) -> DataFrame:
    """path, verdict and reason for each changed file. files: path, status, binary, old_hash, new_hash, similarity, and old_text
    and new_text where dependency manifests are to be compared: of these only a major version or a dependency that comes or goes proceeds.

    With these texts, files of a known language that differ only in comments, blanks and the wording of texts count as equal; without, only equal
    content does.
    """
    ignored = F.lit(False)
    for glob in ignore:
        ignored = ignored | F.col("path").rlike(path_pattern(glob))
    texts = {"old_text", "new_text"} <= set(files.columns)
    same = F.col("old_hash") == F.col("new_hash")
    if texts:
        known = files.withColumns({"__old": significant_key(F.col("path"), F.when(~same, F.col("old_text"))), "__new": significant_key(F.col("path"), F.when(~same, F.col("new_text")))})
        files, alike = known, F.coalesce(F.col("__old") == F.col("__new"), F.lit(False))
    else:
        alike = F.lit(False)
    reason = (
        F.when(F.col("path").rlike(DOC_PATHS), "documentation").when(ignored, "ignored").when(F.lower("path").rlike(r"\.(md|markdown|mdx|rst)$") & (F.col("status") != "deleted"), "markdown").when(F.col("binary"), "binary")
        .when(F.col("status") == "deleted", "deleted").when((same | alike) & (F.col("status") == "renamed"), F.when(F.col("similarity") >= 90, "renamed").otherwise("moved")).when(same, "same content").when(alike, "same tokens")
    )
    if texts:
        old, new = (dependencies(F.col("path"), F.col(c)) for c in ("old_text", "new_text"))
        read = old.isNotNull() & new.isNotNull() & (F.size(old) + F.size(new) > 0)
        reason = F.coalesce(reason, F.when(read, F.when(F.size(major_bumps(old, new)) > 0, "major dependency").otherwise("minor dependency")))
    return files.select("path", F.when(reason.isin("deleted", "moved", "major dependency") | reason.isNull(), "proceed").otherwise("abort").alias("verdict"), F.coalesce(reason, F.lit("changed")).alias("reason"))
