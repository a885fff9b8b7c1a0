"""Property graph and document tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: node, other, kind. Two equi-joins instead of one with OR."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "kind").unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "kind"))


def with_ends(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges between live entities, with both ends' kind and name."""
    live = entities.where("deleted_at IS NULL")
    end = lambda p: live.select(F.col("id").alias(p), F.col("kind").alias(f"{p}_kind"), F.col("name").alias(f"{p}_name"))
    return edges.join(end("src"), "src").join(end("dst"), "dst")


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, kinds: list[str] | None = None) -> DataFrame:
    """start, node and distance for all nodes within depth steps of each start node (start: id)."""
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    steps = both_ways(edges).select("node", "other").distinct()
    seen = start.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance"))
    front = seen
    for d in range(1, depth + 1):
        front = front.join(steps, "node").select("start", F.col("other").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def bounded_neighbourhood(edges: DataFrame, entities: DataFrame, start: DataFrame, depth: int, allowed: Column, most: int = 500, kinds: list[str] | None = None) -> DataFrame:
    """start, node and distance as neighbourhood() has them, for readers who may see some entities only, most nodes of each start at most.

    allowed: condition on entities (id, repo_id, ...); an edge counts if both ends are allowed. Nearer nodes come first, then ids.
    A round keeps what the bound lets through, so a hub costs most rows of each start and not all its edges further on.
    """
    seen_by = entities.where(allowed).select("id")
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    open_ = edges.join(seen_by.withColumnRenamed("id", "src"), "src", "left_semi").join(seen_by.withColumnRenamed("id", "dst"), "dst", "left_semi")
    steps = both_ways(open_).select("node", "other").distinct()
    seen = start.join(seen_by, "id", "left_semi").select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("distance"))
    order = Window.partitionBy("start").orderBy("distance", "node")
    for d in range(1, depth + 1):
        new = seen.where(F.col("distance") == d - 1).join(steps, "node").select("start", F.col("other").alias("node")).distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")
        seen = seen.unionByName(new.withColumn("distance", F.lit(d))).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).drop("n")
    return seen


def neighbours(edges: DataFrame, keys: DataFrame, kind: str, entities: DataFrame) -> DataFrame:
    """Distinct one-step neighbours of keys (id) among entities of a kind, without the keys."""
    near = both_ways(edges).join(keys.select(F.col("id").alias("node")), "node", "left_semi").select(F.col("other").alias("id")).distinct()
    own = entities.where((F.col("kind") == kind) & F.col("deleted_at").isNull())
    return near.join(own.select("id"), "id", "left_semi").join(keys.select("id"), "id", "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"))


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Live entities without an edge on either end."""
    live = entities.where("deleted_at IS NULL")
    return live.join(edges.select(F.col("src").alias("id")), "id", "left_anti").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def overview(entities: DataFrame, edges: DataFrame, kinds: list[str], n: int) -> tuple[DataFrame, DataFrame]:
    """The n entities of kinds with most edges, and the edges between them lifted to owners: weights by (src, dst, kind), no loops.

    entities: id, kind, owner (the entity that stands for a finer one, null if it stands for itself).
    """
    top = entities.where(F.col("kind").isin(*kinds)).join(degrees(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = top.orderBy(F.col("degree").desc(), "id").limit(n)
    stands = entities.select("id", F.coalesce("owner", "id").alias("stand"))
    lifted = edges.join(stands.withColumnRenamed("id", "src").withColumnRenamed("stand", "a"), "src").join(stands.withColumnRenamed("id", "dst").withColumnRenamed("stand", "b"), "dst")
    lifted = lifted.where("a <> b").join(top.select(F.col("id").alias("a")), "a", "left_semi").join(top.select(F.col("id").alias("b")), "b", "left_semi")
    return top, lifted.groupBy("a", "b", "kind").agg(F.count("*").alias("weight"))


def ancestors(nodes: DataFrame, most: int = 64) -> DataFrame:
    """id, ancestor and depth (1: the parent, most at most) for every node of nodes (id, parent_id).

    Each round joins what is known with itself and so doubles the depths reached: log2(most) rounds of equi-joins, until no
    node has an ancestor beyond. Rounds are kept by Spark, as each reads the one before three times.
    """
    known = nodes.where("parent_id IS NOT NULL").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("depth"))
    reach = 1
    while reach < most:
        top = known.where(F.col("depth") == reach)
        further = known.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("above"), F.col("depth").alias("more"))
        new = top.join(further, "ancestor").select("id", F.col("above").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth")).where(F.col("depth") <= most)
        known = known.unionByName(new).persist()
        reach *= 2
        if known.where(F.col("depth") == reach).isEmpty():
            break
    return known


def children(nodes: DataFrame) -> DataFrame:
    """nodes with has_children."""
    parents = nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id")).distinct().withColumn("has_children", F.lit(True))
    return nodes.join(parents, "id", "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def through_shared(edges: DataFrame, owners: DataFrame, out: str, into: str) -> DataFrame:
    """Pairs of different owners, one with an out edge and one with an into edge at the same node, with a count and the least node.

    edges: src, dst, kind; owners: id, owner.
    """
    at = lambda kind, name: edges.where(F.col("kind") == kind).join(owners.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("node"), F.col("owner").alias(name))
    pairs = at(out, "a").join(at(into, "b"), "node").where("a <> b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("links"), F.min("node").alias("first"))


def topic_links(edges: DataFrame, owners: DataFrame, out: str = "publishes", into: str = "subscribes") -> DataFrame:
    """source, target, kind (event), via, links and first of different owners with an out and an into edge at the same node.

    links counts pairs of edges, first is the least src of the out edges. Each node's edges are counted by owner before owners
    meet, so a busy node costs its owners' pairs, which are the result, and not its edges'.
    """
    named = edges.join(owners.select(F.col("id").alias("src"), "owner"), "src")
    at = lambda kind, name: named.where(F.col("kind") == kind).groupBy(F.col("dst").alias("via"), F.col("owner").alias(name)).agg(F.count("*").alias(f"{name}_n"), F.min("src").alias(f"{name}_first"))
    pairs = at(out, "source").join(at(into, "target"), "via").where("source <> target")
    return pairs.select("source", "target", F.lit("event").alias("kind"), "via", (F.col("source_n") * F.col("target_n")).alias("links"), F.col("source_first").alias("first"))


#: Kinds of edges that are no link between the owners of their ends.
INNER = ("contains", "owns", "publishes", "subscribes", "documented_in", "runbook_for", "owned_by")


def edge_links(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """source, target, kind (api, call, library, other), via, links and first of edges between entities of different owners, the far one live."""
    far = entities.where("deleted_at IS NULL AND owner IS NOT NULL").select(F.col("id").alias("dst"), F.col("owner").alias("target"), F.col("kind").alias("far_kind"), F.col("name").alias("via"))
    near = entities.where("owner IS NOT NULL").select(F.col("id").alias("src"), F.col("owner").alias("source"))
    kind = F.when(F.col("far_kind") == "endpoint", "api").when(F.col("kind") == "calls", "call").when(F.col("kind") == "depends_on", "library").otherwise("other")
    met = edges.where(~F.col("kind").isin(*INNER)).join(near, "src").join(far, "dst").where("source <> target")
    return met.groupBy("source", "target", kind.alias("kind"), "via").agg(F.count("*").alias("links"), F.min("src").alias("first"))


def system_links(*parts: DataFrame) -> DataFrame:
    """Links of several sources by source, target, kind and via: links summed, the least first. Parts without links and first count rows."""
    each = [d if "links" in d.columns else d.select("source", "target", "kind", "via", F.lit(1).cast("long").alias("links"), F.lit(None).cast("string").alias("first")) for d in parts]
    out = each[0]
    for d in each[1:]:
        out = out.unionByName(d)
    return out.groupBy("source", "target", "kind", "via").agg(F.sum("links").alias("links"), F.min("first").alias("first"))
