"""Who owns files: ordered patterns of owner files, of which the last that fits counts, met by what a path and a pattern have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where owner files stand: fixed values.
PLACES = ("CODEOWNERS", ".github/CODEOWNERS", "docs/CODEOWNERS", ".gitlab/CODEOWNERS")


def rules(files: DataFrame) -> DataFrame:
    """repo, source, line, pattern and owners of the rules in owner files. files: repo, path, content.

    Remarks, section heads and blank lines are none. A pattern without owners is a rule, too: what it fits belongs to nobody.
    """
    lines = files.where(F.col("path").isin(*PLACES)).select("repo", F.col("path").alias("source"), F.posexplode(F.split(F.coalesce("content", F.lit("")), r"\r?\n")).alias("line", "text"))
    said = lines.withColumn("text", F.trim(F.regexp_replace("text", r"(^|[\t ])#.*", ""))).where("text <> '' and not startswith(text, '[')")
    fields = F.split("text", r"[\t ]+")
    return said.select("repo", "source", (F.col("line") + 1).alias("line"), F.get(fields, 0).alias("pattern"), F.slice(fields, 2, 1000).alias("owners"))


def as_regex(pattern: Column) -> Column:
    """What a pattern fits as a regular expression over whole paths: * within a part of the path, ** over parts, a folder all that is in it."""
    anchored = F.rtrim(pattern, F.lit("/")).contains("/")
    body = F.ltrim(F.rtrim(pattern, F.lit("/")), F.lit("/"))
    quoted = F.regexp_replace(body, r"([.+^$(){}|\[\]\\])", r"\\$1")
    # letters that no path holds stand in for what a later step must not read again
    for old, new in ((r"^\*\*/", "\x01"), (r"/\*\*$", "\x02"), (r"/\*\*/", "\x03"), (r"\*\*", "\x04"), (r"\*", "[^/]*"), (r"\?", "[^/]"), ("\x01", "(?:.*/)?"), ("\x02", "/.*"), ("\x03", "/(?:.*/)?"), ("\x04", ".*")):
        quoted = F.regexp_replace(quoted, old, new)
    # a last part of stars alone takes files of that folder; anything else also all below a folder of that name
    below = F.when(pattern.endswith("/"), "/.*").when(pattern.rlike(r"/\*$"), "").otherwise("(?:/.*)?")
    return F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("^(?:.*/)?")), quoted, below, F.lit("$"))


def keyed_rules(known: DataFrame) -> DataFrame:
    """Rules with the key by which files meet them: the path up to the first part with a star, a name, an ending, or nothing."""
    body = F.ltrim(F.rtrim("pattern", F.lit("/")), F.lit("/"))
    anchored = F.rtrim("pattern", F.lit("/")).contains("/")
    parts = F.split(body, "/")
    plain = F.array_join(F.slice(parts, 1, F.coalesce(F.nullif(F.array_position(F.transform(parts, lambda p: p.rlike(r"[*?]")), True), F.lit(0)) - 1, F.size(parts)).cast("int")), "/")
    ending = F.regexp_extract(body, r"^\*(\.[^.*?/]+)$", 1)
    key = F.when(anchored, F.concat(F.lit("path:"), plain)).when(~body.rlike(r"[*?]"), F.concat(F.lit("name:"), body)).when(ending != "", F.concat(F.lit("ending:"), ending)).otherwise("path:")
    return known.withColumns({"key": key, "regex": as_regex(F.col("pattern"))})


def keyed_files(files: DataFrame) -> DataFrame:
    """repo, path and each key by which a rule can fit it: at most three for each part of the path and one more."""
    parts = F.split("path", "/")
    paths = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat(F.lit("path:"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    names = F.transform(parts, lambda p: F.concat(F.lit("name:"), p))
    # a folder can have an ending, too
    ending = F.transform(parts, lambda p: F.concat(F.lit("ending:"), F.regexp_extract(p, r"(\.[^.]+)$", 1)))
    return files.select("repo", "path", F.explode(F.array_distinct(F.concat(paths, names, ending))).alias("key"))


def file_owners(files: DataFrame, known: DataFrame) -> DataFrame:
    """repo, path, owners, pattern and line: the last rule of its repository that fits each file; null where none does, no owners where it names none.

    files: repo, path (relative, once each). known: what rules gives, of one owner file for each repository. Files meet rules by key, so a
    rule is held against files below its folder, of its name or its ending only, whatever the number of rules.
    """
    met = keyed_files(files).join(keyed_rules(known).select("repo", "key", "regex", "owners", "pattern", "line"), ["repo", "key"]).where(F.expr("path rlike regex"))
    last = met.groupBy("repo", "path").agg(F.max(F.struct("line", "pattern", "owners")).alias("rule"))
    return files.select("repo", "path").join(last, ["repo", "path"], "left").select("repo", "path", "rule.owners", "rule.pattern", "rule.line")


def owner_edges(known: DataFrame) -> DataFrame:
    """repo, subject, owner, kind (team or person), source and line: rules for all files own the repository, those for a folder that folder as a module.

    Rules with stars in them name no module; the subject of the repository is an empty text.
    """
    folder = F.trim(F.regexp_replace(F.regexp_replace("pattern", r"\*\*$", ""), r"\*$", ""), F.lit("/"))
    every = F.col("pattern").isin("*", "/*", "/")
    some = known.withColumn("subject", F.when(every, "").otherwise(folder)).where(every | ((F.col("subject") != "") & ~F.col("subject").rlike(r"[*?]")))
    each = some.select("repo", "subject", F.explode(F.array_distinct("owners")).alias("owner"), "source", "line")
    return each.withColumn("kind", F.when(F.col("owner").startswith("@") & F.col("owner").contains("/"), "team").otherwise("person"))
