"""The architecture of repositories as layers of boxes: what calls them, what they expose, what they are, and what they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.graph import degrees
from millrace.operators.system import endpoint_group

#: Boxes of each layer at most, from left to right: fixed values.
CAPS = {"upstream": 10, "interface": 14, "core": 9, "messaging": 12, "data": 10, "downstream": 12}
ORDER = {layer: i for i, layer in enumerate(CAPS)}
#: Kinds of shared entities that belong to the repository whose code gave the edge, and edges that say nothing of structure: fixed values.
OWN_KINDS = ("symbol", "file", "module", "repo", "service")
ASIDE = ("reads_env", "documented_in", "runbook_for", "owned_by", "deployed_as", "contains", "raises")
#: Parts of a folder's name that make it one of tests: fixed values.
TESTS = ("test", "tests", "e2e", "testdata", "mocks", "mock", "fixtures", "__tests__", "spec", "testutil", "storetest")


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def box(node: Column, kind: Column | str, name: Column, layer: str, entity: Column, size: Column | str) -> Column:
    """A box of the picture: entity is what it counts, size how (degree: of that entity, count: of all in the box, none)."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(node.alias("node"), text(kind).alias("kind"), name.alias("name"), F.lit(layer).alias("layer"), entity.alias("entity"), text(size).alias("size"))


def endpoint_box(id: Column, group: Column) -> Column:
    return box(F.concat(F.lit("api:"), group), "endpoint_group", group, "interface", id, "count")


def main_modules(entities: DataFrame) -> DataFrame:
    """Modules (with folder) worth a box: none of tests, and no folder that only holds other modules of its repository."""
    folder = F.when(F.col("key").contains(":"), F.substring_index("key", ":", -1)).otherwise(F.col("name"))
    own = entities.where("kind = 'module' and repo IS NOT NULL").withColumn("folder", folder)
    own = own.where(~F.arrays_overlap(F.split(F.lower("folder"), "/"), F.array(*map(F.lit, TESTS))))
    parts = F.split("folder", "/")
    above = own.where(F.size(parts) > 1).select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("folder")).distinct()
    return own.join(above, ["repo", "folder"], "left_anti")


def architecture(entities: DataFrame, edges: DataFrame, repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes (repo, layer, place, node, kind, name, size) and links (repo, src, dst, kind, weight) of every repository at once.

    entities: id, kind, name, key, repo (null: shared). edges: src, dst, kind, repo (whose code gave it; may be null). repos: repo, name. Each edge is
    looked at from the repositories that it touches, three at most. Of each layer the boxes of the highest size are kept, as many as CAPS says, equal
    ones by name; the rest become one box of kind others, whose size is their number, behind them. Links are those between boxes that are kept. A
    repository without a service stands for itself. A box that would lie in two layers lies in the left one.
    """
    e = entities.select("id", "kind", "name", "key", F.col("repo").alias("own"), F.when(F.col("kind") == "endpoint", endpoint_group(F.col("name"))).alias("group"))
    core = entities.where("kind = 'service' and repo IS NOT NULL").select("repo", "id").unionByName(edges.where("kind = 'deployed_as' and repo IS NOT NULL").select("repo", F.col("dst").alias("id"))).distinct()
    services = core.join(e.where("kind = 'service'").select("id", "kind", "name"), "id")
    first = services.groupBy("repo").agg(F.min_by(F.struct("id", "name"), F.struct("name", "id")).alias("s"))
    anchors = repos.withColumnRenamed("name", "title").join(first, "repo", "left").select(
        "repo", F.coalesce("s.id", F.concat(F.lit("repo:"), "repo")).alias("anchor"), F.when(F.col("s").isNull(), "repo").otherwise("service").alias("anchor_kind"), F.coalesce("s.name", "title").alias("anchor_name"), F.col("s.id").alias("anchor_entity"))
    end = lambda side: e.select(*[F.col(c).alias(f"{side}_{c}") for c in e.columns])
    known = edges.where(~F.col("kind").isin(*ASIDE)).select(F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), F.col("kind").alias("edge"), F.col("repo").alias("by"))
    known = known.join(end("src"), "src_id").join(end("dst"), "dst_id")
    views = F.array_distinct(F.array_compact(F.array("src_own", "dst_own", "by")))
    known = known.withColumn("repo", F.explode(views)).join(anchors, "repo")
    for side in ("src", "dst"):
        known = known.join(core.select("repo", F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_core")), ["repo", f"{side}_id"], "left")
        own, by = F.col(f"{side}_own"), F.col("by").eqNullSafe(F.col("repo")) & F.col(f"{side}_kind").isin(*OWN_KINDS)
        known = known.withColumn(f"{side}_here", F.when(own.isNotNull(), own == F.col("repo")).otherwise(F.coalesce(f"{side}_core", F.lit(False)) | by))
    names = repos.select(F.col("repo").alias("__id"), F.col("name").alias("__name"))
    for side in ("src", "dst"):
        known = known.join(names.withColumnsRenamed({"__id": f"{side}_own", "__name": f"{side}_title"}), f"{side}_own", "left")

    def here(side: str) -> Column:
        c = lambda n: F.col(f"{side}_{n}")
        anchor = box(F.col("anchor"), F.col("anchor_kind"), F.col("anchor_name"), "core", F.col("anchor_entity"), "degree")
        return F.when(c("kind") == "endpoint", endpoint_box(c("id"), c("group"))).when(c("core"), box(c("id"), c("kind"), c("name"), "core", c("id"), "degree")).otherwise(anchor)

    def there(side: str, layer: str) -> Column:
        c = lambda n: F.col(f"{side}_{n}")
        group = F.substring_index(c("key"), ":", 1)
        return (
            F.when(c("own").isNotNull(), box(F.concat(F.lit("repo:"), c("own")), "repo", F.coalesce(c("title"), c("own")), layer, F.lit(None).cast("string"), "none"))
            .when(c("kind") == "dependency", box(F.concat(F.lit("deps:"), group), "dependency_group", F.concat(group, F.lit(" packages")), layer, c("id"), "count"))
            .otherwise(box(c("id"), c("kind"), c("name"), layer, c("id"), "degree"))
        )

    plain = lambda side, layer: box(F.col(f"{side}_id"), F.col(f"{side}_kind"), F.col(f"{side}_name"), layer, F.col(f"{side}_id"), "degree")
    sh, dh = F.col("src_here"), F.col("dst_here")
    arrow = lambda a, b, kind: F.struct(a.alias("a"), b.alias("b"), kind.alias("kind"))
    topic = plain("dst", "messaging")
    link = (
        F.when(sh & dh, F.when(F.col("edge").isin("exposes", "calls"), arrow(here("src"), here("dst"), F.col("edge"))))
        .when(sh & (F.col("dst_kind") == "queue_topic"), F.when(F.col("edge") == "subscribes", arrow(topic, here("src"), F.col("edge"))).otherwise(arrow(here("src"), topic, F.col("edge"))))
        .when(sh & (F.col("dst_kind") == "datastore"), arrow(here("src"), plain("dst", "data"), F.col("edge")))
        .when(sh, arrow(here("src"), there("dst", "downstream"), F.col("edge")))
        .when(dh, arrow(there("src", "upstream"), here("dst"), F.col("edge")))
    )
    drawn = known.select("repo", link.alias("l")).where("l IS NOT NULL").select("repo", "l.*").where("a.node <> b.node")
    entity = lambda df: df.join(anchors, "repo")
    anchor_box = box(F.col("anchor"), F.col("anchor_kind"), F.col("anchor_name"), "core", F.col("anchor_entity"), "degree")
    inside = entity(main_modules(entities).select("repo", "id", "kind", "name")).select("repo", arrow(anchor_box, box(F.col("id"), F.col("kind"), F.col("name"), "core", F.col("id"), "degree"), F.lit("contains")).alias("l"))
    exposed = entity(e.where("kind = 'endpoint' and own IS NOT NULL").select(F.col("own").alias("repo"), "id", "group")).select("repo", arrow(anchor_box, endpoint_box(F.col("id"), F.col("group")), F.lit("exposes")).alias("l"))
    drawn = drawn.unionByName(inside.unionByName(exposed).select("repo", "l.*"))
    alone = anchors.select("repo", anchor_box.alias("box")).unionByName(services.join(anchors, "repo").select("repo", box(F.col("id"), F.col("kind"), F.col("name"), "core", F.col("id"), "degree").alias("box")))

    boxes = drawn.select("repo", F.col("a").alias("box")).unionByName(drawn.select("repo", F.col("b").alias("box"))).unionByName(alone).select("repo", "box.*")
    left = F.min_by(F.struct("layer", "kind", "name", "size"), lookup(ORDER, F.col("layer")))
    sized = boxes.groupBy("repo", "node").agg(left.alias("x"), F.count_distinct("entity").alias("members"), F.min("entity").alias("entity")).join(degrees(edges).withColumnRenamed("node", "entity"), "entity", "left")
    size = F.when(F.col("x.size") == "count", F.col("members")).when(F.col("x.size") == "degree", F.coalesce("degree", F.lit(0))).otherwise(0).cast("long")
    sized = sized.select("repo", "node", "x.layer", "x.kind", "x.name", size.alias("size")).join(anchors.select("repo", "anchor"), "repo")
    place = F.row_number().over(Window.partitionBy("repo", "layer").orderBy((F.col("node") != F.col("anchor")), F.desc("size"), "name", "node"))
    placed = sized.withColumn("place", place).withColumn("cap", lookup(CAPS, F.col("layer")))
    kept = placed.where("place <= cap").select("repo", "layer", "place", "node", "kind", "name", "size")
    rest = placed.where("place > cap").groupBy("repo", "layer", "cap").agg(F.count("*").alias("size"))
    rest = rest.select("repo", "layer", (F.col("cap") + 1).alias("place"), F.concat(F.lit("others:"), "layer").alias("node"), F.lit("others").alias("kind"), F.lit("others").alias("name"), "size")
    shown = kept.select("repo", "node")
    links = drawn.select("repo", F.col("a.node").alias("src"), F.col("b.node").alias("dst"), "kind").groupBy("repo", "src", "dst", "kind").agg(F.count("*").alias("weight"))
    links = links.join(shown.withColumnRenamed("node", "src"), ["repo", "src"], "left_semi").join(shown.withColumnRenamed("node", "dst"), ["repo", "dst"], "left_semi")
    return kept.unionByName(rest), links.select("repo", "src", "dst", "kind", "weight")
