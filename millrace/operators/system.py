"""Links between repositories, architecture views, extraction from text, navigation and versioned indexes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.rules import matched

#: Endings of host names that resolve only inside a deployment: fixed values.
INTERNAL = (".svc", ".svc.cluster.local", ".cluster.local", ".internal", ".local", ".consul", ".lan", ".intranet", ".private")


def internal_host(host: Column) -> Column:
    return reduce(lambda a, s: a | host.endswith(s), INTERNAL, ~host.contains(".") | host.contains(".svc."))


def image_name(reference: Column, repo: Column) -> Column:
    """An image without tag and digest, null if it is built from variables or scratch."""
    x = F.regexp_replace(F.trim(reference), "^[\"']+|[\"']+$", "")
    x = F.replace(x, F.lit("${{ github.repository }}"), F.lower(repo))
    bad = (x == "") | x.rlike(r"[${}]") | (F.lower(x) == "scratch")
    x = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "@.*$", ""), r":[^:/]*$", ""), r"^(?:index\.)?docker\.io/", ""))
    return F.when(~bad, F.regexp_replace(x, "^library/", ""))


def wiring_links(repos: DataFrame, wires: DataFrame) -> DataFrame:
    """source, target, kind and via of links by configuration. repos: id, name, service. wires: repo, kind (host, calls, image_pub, image_use, ci_ref), value.

    Three equi-joins on identities, and image suffixes by exploding the suffixes of what is used, not by comparing all pairs.
    """
    full = F.lower("name")
    last = F.element_at(F.split(full, "/"), -1)
    hosts = wires.where("kind = 'host'")
    own = repos.select("id", full.alias("full"), last.alias("last"), F.lower("service").alias("service"))
    names = own.select("id", F.explode(F.array_compact(F.array("last", F.nullif("service", F.lit(""))))).alias("key")).unionByName(hosts.where(~F.col("value").contains(".")).select(F.col("repo").alias("id"), F.col("value").alias("key"))).distinct()
    calls = wires.where("kind = 'calls'").select("repo", F.col("value").alias("via"), F.substring_index("value", ".", 1).alias("first"))
    by_host = calls.join(hosts.select(F.col("repo").alias("id"), F.col("value").alias("via")).distinct(), "via").select("repo", "id", "via")
    by_name = calls.where(internal_host(F.col("via"))).join(names, F.col("first") == F.col("key")).select("repo", "id", "via")
    api = by_host.unionByName(by_name).distinct().withColumn("kind", F.lit("api"))
    used = wires.where("kind = 'image_use'").select("repo", F.col("value").alias("via"))
    published = own.select("id", F.col("full").alias("key")).unionByName(wires.where("kind = 'image_pub'").select(F.col("repo").alias("id"), F.col("value").alias("key"))).distinct()
    parts = F.split("via", "/")
    suffixes = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    exact = used.join(published, F.col("via") == F.col("key")).select("repo", "id", "via")
    tail = used.where(F.col("via").contains("/")).withColumn("key", F.explode(suffixes)).join(own.select("id", F.col("full").alias("key")), "key").select("repo", "id", "via")
    image = exact.unionByName(tail).distinct().withColumn("kind", F.lit("image"))
    pipeline = wires.where("kind = 'ci_ref'").join(own, F.col("value") == F.col("full")).select("repo", "id", F.col("value").alias("via")).distinct().withColumn("kind", F.lit("pipeline"))
    return api.unionByName(image).unionByName(pipeline).where("repo <> id").select(F.col("repo").alias("source"), F.col("id").alias("target"), "kind", "via")


def package_links(dependencies: DataFrame, repos: DataFrame) -> DataFrame:
    """repo, id and name of dependencies that are repositories: named alike, with @ before, or within the name's path parts."""
    dep = F.lower("name")
    parts = F.split(F.regexp_replace(dep, "^@", ""), "/")
    n = F.size(parts)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(parts, i, k), "/"))))
    each = dependencies.select("repo", "name", F.explode(F.array_distinct(runs)).alias("key"))
    named = repos.select("id", F.lower("full_name").alias("key"))
    hit = each.join(named, "key").where(F.col("repo") != F.col("id"))
    low, key = F.lower("name"), F.col("key")
    ok = (low == key) | (low == F.concat(F.lit("@"), key)) | low.endswith(F.concat(F.lit("/"), key)) | low.contains(F.concat(F.lit("/"), key, F.lit("/")))
    return hit.where(ok).select("repo", "id", "name").distinct()


def endpoint_group(name: Column) -> Column:
    """The resource of an endpoint: 'GET /api/v1/orders/{id}' is /orders."""
    route = F.when(F.instr(name, " ") > 0, F.substr(name, F.instr(name, " ") + 1)).otherwise(name)
    route = F.regexp_replace(F.regexp_replace(route, r"^/(?:api/)?v[0-9]+(?:/|$)|^/api(?:/|$)", "/"), "^/", "")
    first = F.substring_index(route, "/", 1)
    return F.when((first == "") | first.rlike(r"^[{:$]"), "/").otherwise(F.concat(F.lit("/"), first))


def grouped_endpoints(endpoints: DataFrame, most: int = 50) -> DataFrame:
    """repo, group, how many and the first most names."""
    return endpoints.groupBy("repo", endpoint_group(F.col("name")).alias("group")).agg(F.count("*").alias("count"), F.slice(F.sort_array(F.collect_set("name")), 1, most).alias("items"))


# What an environment variable's name says about a store, in order.
STORES = [("POSTGRES|PGHOST|PG_|PGDATABASE", "postgres"), ("MYSQL", "mysql"), ("MONGO", "mongodb"), ("REDIS", "redis"), ("DYNAMO", "dynamodb"), ("ELASTIC|OPENSEARCH", "elasticsearch"), ("CASSANDRA", "cassandra"), ("S3_BUCKET|BUCKET_NAME|_BUCKET$", "object_storage"), ("DATABASE_URL|DB_URL|DB_HOST|DB_DSN|JDBC_URL|DATASOURCE_URL", "sql_database")]
ENV = r"(?:os\.Getenv\(|os\.environ(?:\.get\(|\[)|process\.env\.|System\.getenv\(|getenv\()[\"']?([A-Z][A-Z0-9_]{2,})"
ROUTE = r"[\w)\]]\.(Get|Post|Put|Delete|Patch|Head|Options|GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|get|post|put|delete|patch|head|options)\(\s*[\"'`](/[^\"'`\s]*)"
PUBLISH = r"(?i:producer|publisher|kafka|pubsub|sns|topic|queue|bus|channel|broker|client)\w*\.(?:Publish|publish|Produce|produce|SendMessage|send_message|sendMessage|send|emit)\(\s*[\"'`]([A-Za-z0-9][A-Za-z0-9._:-]{1,200})[\"'`]"
SUBSCRIBE = r"(?i:consumer|subscriber|subscription|kafka|pubsub|sqs|topic|queue|bus|channel|broker|client)\w*\.(?:Subscribe|subscribe|Consume|consume|ReceiveMessage|receive_message)\(\s*[\"'`]([A-Za-z0-9][A-Za-z0-9._:-]{1,200})[\"'`]"


def datastore(variable: Column) -> Column:
    out = None
    for pattern, kind in STORES:
        hit = F.upper(variable).rlike(pattern)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def extracted(files: DataFrame) -> DataFrame:
    """path, kind (endpoint, env_var, datastore, publishes, subscribes) and name found in files (path, content) by patterns; grammars are not used."""
    find = lambda p, g: F.regexp_extract_all("content", F.lit(p), F.lit(g))
    variables = find(ENV, 1)
    named = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    routes = F.zip_with(find(ROUTE, 1), find(ROUTE, 2), lambda m, r: F.concat(F.upper(m), F.lit(" "), r))
    stores = F.array_compact(F.transform(variables, datastore))
    found = F.concat(named("endpoint", routes), named("env_var", variables), named("datastore", stores), named("publishes", find(PUBLISH, 1)), named("subscribes", find(SUBSCRIBE, 1)))
    return files.select("path", F.explode(F.array_distinct(found)).alias("f")).select("path", "f.kind", "f.name")


def module_edges(calls: DataFrame, modules: DataFrame) -> DataFrame:
    """File calls (src, dst, n) summed to module calls. modules: path, module."""
    m = modules.select("path", "module")
    x = calls.join(m.select(F.col("path").alias("src"), F.col("module").alias("a")), "src").join(m.select(F.col("path").alias("dst"), F.col("module").alias("b")), "dst")
    return x.where("a <> b").groupBy("a", "b").agg(F.sum("n").alias("calls"), F.count("*").alias("files"))


def split_modules(files: DataFrame, most: int = 15_000, least: int = 300, depth: int = 12) -> DataFrame:
    """path and module: the shallowest directory of a file with at most most lines, or its deepest; one under least joins its parent."""
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(depth))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = files.select("path", "lines", F.posexplode(dirs).alias("level", "dir"))
    sizes = each.groupBy("dir").agg(F.sum("lines").alias("size"))
    own = each.join(sizes, "dir").groupBy("path").agg(F.sort_array(F.collect_list(F.struct("level", "dir", "size"))).alias("ways"))
    fits = F.filter("ways", lambda w: w["size"] <= most)
    pick = F.when(F.size(fits) > 0, fits[0]).otherwise(F.element_at("ways", -1))
    chosen = own.select("path", pick.alias("p"), "ways")
    above = F.element_at(F.filter("ways", lambda w: w["level"] < F.col("p.level")), -1)
    small = (F.col("p.size") < least) & (F.col("p.level") > 0)
    return chosen.select("path", F.when(small, F.coalesce(F.try_element_at(F.filter("ways", lambda w: w["level"] == F.col("p.level") - 1), F.lit(1))["dir"], above["dir"])).otherwise(F.col("p.dir")).alias("module"))


def navigated(directories: DataFrame, files: DataFrame, at: float = 0.5, levels: int = 8, dirs: int = 120, previews: int = 60, reads: int = 8) -> DataFrame:
    """query_id, path and rank of the files to read: from the roots down, through directories judged at least at, best first; then the best of up to previews files.

    directories: query_id, path, parent (null: a root), score. files: query_id, path, dir, score. Budgets are for each query.
    """
    by_query = Window.partitionBy("query_id")
    best = lambda d, n: d.withColumn("__n", F.row_number().over(by_query.orderBy(F.col("score").desc(), "path"))).where(F.col("__n") <= n).drop("__n")
    front, opened = directories.where("parent IS NULL"), None
    for _ in range(levels):
        good = front.where(F.col("score") >= at).select("query_id", "path", "score")
        opened = good if opened is None else opened.unionByName(good)
        front = directories.join(good.select("query_id", F.col("path").alias("parent")), ["query_id", "parent"])
    inside = files.join(best(opened, dirs).select("query_id", F.col("path").alias("dir"), F.col("score").alias("__dir")), ["query_id", "dir"])
    seen = inside.withColumn("__n", F.row_number().over(by_query.orderBy(F.col("__dir").desc(), "dir", "path"))).where(F.col("__n") <= previews)
    order = by_query.orderBy(F.col("score").desc(), "path")
    return seen.where(F.col("score") >= at).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= reads).select("query_id", "path", "rank")


def standing_decodes(decodes: DataFrame, chunks: DataFrame, version: int) -> DataFrame:
    """id and fresh: same fingerprint version, and every blamed chunk live with the content it had. decodes: id, version, affected (chunk_id, hash)."""
    each = decodes.select("id", "version", F.explode_outer("affected").alias("a"))
    live = chunks.where("deleted_at IS NULL").select("chunk_id", "content_hash")
    same = each.join(live, F.col("a.chunk_id") == F.col("chunk_id"), "left").withColumn("ok", F.col("a").isNull() | F.coalesce(F.col("content_hash") == F.col("a.hash"), F.lit(False)))
    return same.groupBy("id").agg((F.first("version") == version).alias("v"), F.bool_and("ok").alias("ok")).select("id", (F.col("v") & F.col("ok")).alias("fresh"))


def dry_run(samples: DataFrame, rule: dict, now: Column, days: int = 7) -> DataFrame:
    """Issues whose newest sample of the last days a rule would match. samples: fingerprint, received_at, event_id and what rules look at."""
    recent = samples.where(F.col("received_at") > now - F.make_interval(days=F.lit(days)))
    newest = recent.withColumn("__n", F.row_number().over(Window.partitionBy("fingerprint").orderBy(F.col("received_at").desc(), "event_id"))).where("__n = 1").drop("__n")
    return matched(newest, [rule], now).where("rule_id IS NOT NULL").select("fingerprint", "event_id")


def any_term(issues: DataFrame, terms: list[str], column: str = "title") -> DataFrame:
    """Issues whose column holds any of some terms, whatever the case."""
    listed = F.array(*(F.lit(t.lower()) for t in terms))
    return issues.where(F.exists(listed, lambda t: F.instr(F.lower(F.col(column)), t) > 0)) if terms else issues.limit(0)


class VersionedIndex:
    """A table in numbered folders below a path, with a pointer to the live one: build the next, swap, or abort."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _pointer(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("live int, at timestamp").json(f"{self.path}/pointer")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def live(self) -> int:
        """The live version, 0 before the first."""
        p = self._pointer()
        row = p.orderBy(F.col("at").desc(), F.col("live").desc()).first() if p is not None else None
        return row.live if row else 0

    def build(self, rows: DataFrame) -> int:
        """Writes the next version beside the live one, and returns its number."""
        version = self.live() + 1
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")
        return version

    def add(self, rows: DataFrame, pending: int | None = None) -> None:
        """Appends to the live version, and to the pending one while it is built."""
        for v in {self.live(), pending} - {0, None}:
            rows.write.mode("append").parquet(f"{self.path}/v{v}")

    def swap(self, version: int) -> None:
        """Makes a version live: one small file is added, so readers see the old or the new one."""
        if version <= self.live():
            raise ValueError("a newer version is live")
        self.spark.range(1).select(F.lit(version).alias("live"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(f"{self.path}/pointer")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.live()}")

