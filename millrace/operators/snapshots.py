"""Two snapshots of a tree of files: what was added, changed and removed, and what only moved, by how much of their lines files share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import written

#: Per cent of the larger file that two files share at least if one is to be the other under a new path.
LEAST = 50


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def line_counts(files: DataFrame) -> DataFrame:
    """path, line (its hash), n and bytes: how often each line stands in a file, and what one of it weighs. files: path, content."""
    lines = files.select("path", F.explode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("text")).where("text <> ''")
    return lines.groupBy("path", F.md5("text").alias("line")).agg(F.count("*").alias("n"), F.first(F.octet_length("text") + 1).alias("bytes"))


def moved_whole(gone: DataFrame, come: DataFrame) -> DataFrame:
    """old_path, path of files whose content is the same: those that keep their name first, the rest in the order of their paths.

    Equal files meet by their place among their equals, never each with each.
    """
    out = None
    for key in (["hash", "name"], ["hash"]):
        place = F.row_number().over(Window.partitionBy(*key).orderBy("path")).alias("place")
        old = gone.select(*key, F.col("path").alias("old_path"), place)
        new = come.select(*key, "path", place)
        found = old.join(new, [*key, "place"]).select("old_path", "path")
        gone, come = gone.join(found, gone.path == found.old_path, "left_anti"), come.join(found, "path", "left_anti")
        out = found if out is None else out.unionByName(found)
    return out


def similar_pairs(gone: DataFrame, come: DataFrame, least: int = LEAST) -> DataFrame:
    """old_path, path and similarity of all pairs of files that share at least least per cent of the bytes of the larger one, in whole lines.

    gone, come: path, content. If a pair does, the rarest line that both hold lies before the last least per cent of either file's lines, taken by
    rising frequency: files meet by these lines alone, and only pairs that met and are near enough in size are compared.
    """
    old, new = (written(line_counts(f), "lines") for f in (gone, come))
    spread = old.select("line").unionByName(new.select("line")).groupBy("line").agg(F.count("*").alias("files"))
    sides = []
    for lines in (old, new):
        by_file = Window.partitionBy("path")
        rest = by_file.orderBy("files", "line").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        weighed = lines.join(spread, "line").withColumn("weight", F.col("n") * F.col("bytes")).withColumns({"total": F.sum("weight").over(by_file), "rest": F.sum("weight").over(rest)})
        sides.append(weighed.where(100 * F.col("rest") >= least * F.col("total")).select("path", "line", "total"))
    a, b = sides[0].withColumnsRenamed({"path": "old_path", "total": "old_total"}), sides[1]
    near = 100 * F.least("old_total", "total") >= least * F.greatest("old_total", "total")
    met = a.join(b, "line").where(near).groupBy("old_path", "path").agg(F.first(F.greatest("old_total", "total")).alias("larger"))
    shared = met.join(old.select(F.col("path").alias("old_path"), "line", F.col("n").alias("old_n"), "bytes"), "old_path").join(new.select("path", "line", "n"), ["path", "line"])
    found = shared.groupBy("old_path", "path", "larger").agg(F.sum(F.least("n", "old_n") * F.col("bytes")).alias("bytes"))
    return found.select("old_path", "path", F.expr("cast(100 * bytes div larger as int)").alias("similarity")).where(F.col("similarity") >= least)


def assigned(pairs: DataFrame) -> DataFrame:
    """Pairs of which each path has at most one: the most similar first, then those that keep their name, then by a hash of both paths.

    In each round all pairs that are the best of both their files are taken, as taking the best of all again and again would. The hash lets
    equally similar ones be taken many at once.
    """
    order = [F.desc("similarity"), F.desc(base_name(F.col("old_path")) == base_name(F.col("path"))), F.xxhash64("old_path", "path"), "old_path", "path"]
    pairs, out = written(pairs, "pairs"), None
    while not pairs.isEmpty():
        ranked = pairs.withColumn("a", F.row_number().over(Window.partitionBy("old_path").orderBy(*order))).withColumn("b", F.row_number().over(Window.partitionBy("path").orderBy(*order)))
        best = written(ranked.where("a = 1 and b = 1").drop("a", "b"), "assigned")
        pairs = written(pairs.join(best.select("old_path"), "old_path", "left_anti").join(best.select("path"), "path", "left_anti"), "pairs")
        out = best if out is None else out.unionByName(best)
    return pairs if out is None else out


def change_feed(old: DataFrame, new: DataFrame, least: int = LEAST) -> DataFrame:
    """path, status (added, modified, deleted, renamed), old_path and similarity (renamed files) of all files that differ between two snapshots.

    old, new: path (once each), content (text; null counts as empty). A file that is gone and one that has come are one renamed file if their
    content is equal (similarity 100), or else if the pair is assigned to each other. Empty files move only as equals do.
    """
    a = old.select("path", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"), base_name(F.col("path")).alias("name"))
    b = new.select("path", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"), base_name(F.col("path")).alias("name"))
    modified = b.join(a.select("path", F.col("hash").alias("before")), "path").where("hash <> before").select("path")
    gone, come = a.join(b.select("path"), "path", "left_anti"), b.join(a.select("path"), "path", "left_anti")
    whole = written(moved_whole(gone.select("path", "hash", "name"), come.select("path", "hash", "name")).withColumn("similarity", F.lit(100)), "moved")
    left = gone.join(whole.select(F.col("old_path").alias("path")), "path", "left_anti").select("path", "content"), come.join(whole.select("path"), "path", "left_anti").select("path", "content")
    renamed = whole.unionByName(assigned(similar_pairs(*left, least)).select("old_path", "path", "similarity"))
    nothing = [F.lit(None).cast("string").alias("old_path"), F.lit(None).cast("int").alias("similarity")]
    plain = lambda df, status: df.select("path", F.lit(status).alias("status"), *nothing)
    out = renamed.select("path", F.lit("renamed").alias("status"), "old_path", "similarity").unionByName(plain(modified, "modified"))
    out = out.unionByName(plain(come.join(renamed.select("path"), "path", "left_anti"), "added"))
    return out.unionByName(plain(gone.join(renamed.select(F.col("old_path").alias("path")), "path", "left_anti"), "deleted"))
