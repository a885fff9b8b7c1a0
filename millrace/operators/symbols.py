"""Calls and imports between files: symbols are looked up by the scope that imports give, as rounds of joins, without grammars or types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.lexer import bare, language_of
from millrace.session import written

NAME = r"[A-Za-z_$][\w$]*"
DOTTED = rf"{NAME}(?:\.{NAME})*"
#: What stands before a bracket and is no call, by language.
WORDS = {
    "go": "if for switch func return go defer range select case type var const interface struct map chan import package".split(),
    "python": "if elif for while with return await not and or in is lambda assert del yield raise except def class import from async match case".split(),
    "script": "if for while switch catch function return await of in typeof delete super constructor new void throw case import yield instanceof".split(),
}
#: Definitions that stand at the margin: what they are and what they are called, by language.
TOP = {
    "go": [("method", rf"^func\s*\(\s*(?:{NAME}\s+)?\*?({NAME})[^)]*\)\s*({NAME})\s*[(\[]"), ("function", rf"^func\s+()({NAME})\s*[(\[]"), ("type", rf"^type\s+()({NAME})\b")],
    "python": [("function", rf"^(?:async\s+)?def\s+()({NAME})\s*[(\[]"), ("class", rf"^class\s+()({NAME})\b")],
    "script": [("function", rf"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*()({NAME})\s*[(<]"), ("class", rf"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+()({NAME})\b"), ("function", rf"^(?:export\s+)?(?:const|let|var)\s+()({NAME})\s*(?::[^=]*)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=]*=>|{NAME}\s*=>)")],
}
#: Methods, at the margin of a class's body.
INNER = {"python": rf"^\s+(?:async\s+)?def\s+({NAME})\s*[(\[]", "script": rf"^\s+(?:(?:public|private|protected|static|async|override|get|set)\s+)*({NAME})\s*(?:<[^>]*>)?\([^;]*\{{\s*$"}


def family(path: Column) -> Column:
    """go, python or script (TypeScript and JavaScript); null for others."""
    language = language_of(path)
    return F.when(language.isin("typescript", "javascript"), "script").when(language.isin("go", "python"), language)


def keyword(word: Column) -> Column:
    """Whether a word of a file's language (lang) calls nothing."""
    return F.when(F.col("lang") == "go", word.isin(WORDS["go"])).when(F.col("lang") == "python", word.isin(WORDS["python"])).otherwise(word.isin(WORDS["script"]))


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[A-Za-z]+$", "")


def _folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), "/$", "")


def _normal(path: Column) -> Column:
    """A path without . and .. steps; null if it leaves the repository."""
    steps = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda out, s: F.when(s.isin("", "."), out).when((s == "..") & ((F.size(out) == 0) | (F.element_at(out, -1) == "<")), F.array(F.lit("<"))).when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(s))),
    )
    return F.when(~F.array_contains(steps, "<"), F.array_join(steps, "/"))


def unit(path: Column) -> Column:
    """What is imported when a file is: its folder for Go, its path without ending for the others, their index files' folder."""
    stem = _stem(path)
    index = F.regexp_replace(F.regexp_replace(stem, r"(?:^|/)(?:__init__|index)$", ""), "^$", ".")
    return F.when(family(path) == "go", F.coalesce(F.nullif(_folder(path), F.lit("")), F.lit("."))).otherwise(index)


def scanned(files: DataFrame) -> DataFrame:
    """repo, path, lang, code and quoted: contents without comments, and in code without texts. files: repo, path, content."""
    kind = family(F.col("path"))
    known = files.select("repo", "path", kind.alias("lang"), F.coalesce("content", F.lit("")).alias("content")).where("lang IS NOT NULL AND path IS NOT NULL").groupBy("repo", "path", "lang").agg(F.min("content").alias("content"))
    return known.withColumn("b", bare(F.col("path"), F.col("content"))).select("repo", "path", "lang", "b.code", "b.quoted")


def lines(scan: DataFrame) -> DataFrame:
    """repo, path, lang, line (from 1), text, symbol (whose body it is; empty: the file's) and defines (kind, symbol) where one starts.

    What is nested in a function belongs to it; methods are named Class.method. Bodies are told by their margins, so code is taken as formatted.
    """
    found = lambda forms: F.coalesce(*(F.when(F.col("text").rlike(p), F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 1).alias("of"), F.regexp_extract("text", p, 2).alias("name"))) for k, p in forms))
    top = F.when(F.col("lang") == "go", found(TOP["go"])).when(F.col("lang") == "python", found(TOP["python"])).otherwise(found(TOP["script"]))
    method = F.when(F.col("lang") == "python", F.regexp_extract("text", INNER["python"], 1)).when(F.col("lang") == "script", F.regexp_extract("text", INNER["script"], 1))
    row = scan.select("repo", "path", "lang", F.split("code", "\n").alias("all"))
    each = row.select("repo", "path", "lang", F.posexplode("all").alias("at", "text")).where(F.col("text").rlike(r"\S"))
    marked = each.withColumns({"margin": F.length(F.regexp_extract("text", r"^(\s*)", 1)), "top": top, "method": F.when((method != "") & ~keyword(method), method)})
    ordered = Window.partitionBy("repo", "path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    outer = F.when((F.col("margin") == 0) & ~F.col("text").rlike(r"^[)\]}]"), F.struct(F.col("at").alias("at"), F.col("top").alias("d")))
    opened = marked.withColumn("o", F.last(outer, True).over(ordered))
    body = Window.partitionBy("repo", "path", "o.at").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    in_class = F.col("o.d.kind") == "class"
    margin = F.min(F.when(F.col("margin") > 0, F.col("margin"))).over(body)
    inner = opened.withColumn("__m", margin).withColumn("here", F.when(in_class & (F.col("margin") == F.col("__m")) & F.col("method").isNotNull(), F.col("method")))
    # at the margin of the class's body, anything but a method or a closing bracket is the class's own again
    leaves = F.when(F.col("here").isNotNull(), F.col("here")).when((F.col("margin") <= F.col("__m")) & ~F.col("text").rlike(r"^\s*[)\]}]"), F.lit(""))
    named = inner.withColumn("m", F.coalesce(F.last(leaves, True).over(body), F.lit("")))
    outside = F.when(F.col("o.d.of") != "", F.concat("o.d.of", F.lit("."), "o.d.name")).otherwise(F.col("o.d.name"))
    symbol = F.coalesce(F.when(in_class & (F.col("m") != ""), F.concat("o.d.name", F.lit("."), "m")).otherwise(outside), F.lit(""))
    starts = F.when(F.col("here").isNotNull(), F.lit("method")).when((F.col("margin") == 0) & F.col("top").isNotNull(), F.col("top.kind"))
    return named.select("repo", "path", "lang", (F.col("at") + 1).alias("line"), "text", symbol.alias("symbol"), F.when(starts.isNotNull(), F.struct(starts.alias("kind"), symbol.alias("symbol"))).alias("defines"))


def definitions(lined: DataFrame) -> DataFrame:
    """repo, path, symbol, kind and line of the first definition of each symbol of a file."""
    return lined.where("defines IS NOT NULL").groupBy("repo", "path", "symbol").agg(F.min_by("defines.kind", "line").alias("kind"), F.min("line").alias("line"))


def calls(lined: DataFrame) -> DataFrame:
    """repo, path, symbol (the caller; empty: the file), callee (with dots) and line of each call; where a symbol is defined its own name is none."""
    rest = F.when(F.col("defines").isNotNull(), F.regexp_replace("text", rf"^.*?{NAME}(?=\s*[(\[<])(?:\s*)", "")).otherwise(F.col("text"))
    # a Go method's name stands behind its receiver
    rest = F.when(F.col("defines").isNotNull() & F.col("text").rlike(r"^func\s*\("), F.regexp_replace("text", rf"^func\s*\([^)]*\)\s*{NAME}\s*", "")).otherwise(rest)
    rest = F.when(F.col("defines.kind").isin("class", "type"), F.lit("")).otherwise(rest)
    every = F.regexp_extract_all(rest, F.lit(rf"(?<![\w$.@])((?:{DOTTED}))\s*\("), F.lit(1))
    return lined.select("repo", "path", "symbol", "lang", F.explode(every).alias("callee"), "line").where(~keyword(F.col("callee"))).drop("lang")


def imports(scan: DataFrame, modules: DataFrame) -> DataFrame:
    """repo, path, alias (what the file calls it), unit (what is imported, within the repository) and name (null: all of the unit).

    modules: repo, module and folder of each Go module (see go_modules). Imports from outside the repository are left out where it shows, and otherwise
    find no file. An empty alias stands for all names of the unit.
    """
    text = lambda c, p, g: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    pair = lambda a, t, n: F.struct(a.alias("alias"), t.alias("target"), n.alias("name"))
    none = F.lit(None).cast("string")
    # a list of names, each perhaps renamed
    names = lambda listed, target, joiner: F.transform(
        F.filter(F.transform(F.split(F.regexp_replace(listed, r"[(){}\\]", " "), ","), lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), "^type ", "")), lambda x: x.rlike(rf"^(?:{NAME}|\*)(?: {joiner} {NAME})?$")),
        lambda x: pair(F.when(x == "*", "").otherwise(F.element_at(F.split(x, " "), -1)), target, F.when(x != "*", F.element_at(F.split(x, " "), 1))),
    )
    # Python: from a import b; import a.b as c
    place = F.concat(F.lit("/"), _folder(F.col("path")))
    dots = lambda m: F.length(F.regexp_extract(m, r"^(\.*)", 1))
    within = lambda m: F.when(dots(m) > 0, _normal(F.concat(place, F.repeat(F.lit("/.."), F.greatest(dots(m) - 1, F.lit(0))), F.lit("/"), F.replace(F.regexp_replace(m, r"^\.+", ""), F.lit("."), F.lit("/"))))).otherwise(F.replace(m, F.lit("."), F.lit("/")))
    clause = r"(?m)^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]*(\([^)]*\)|(?:[^\n\\]|\\\n)+)"
    froms = F.flatten(F.zip_with(text("code", clause, 1), text("code", clause, 2), lambda m, listed: names(listed, F.coalesce(F.nullif(within(m), F.lit("")), F.when(dots(m) > 0, ".")), "as")))
    whole = F.flatten(F.transform(text("code", r"(?m)^[ \t]*import[ \t]+([\w., \t]+)", 1), lambda x: F.split(x, ",")))
    plain = F.transform(whole, lambda x: pair(F.regexp_extract(F.trim(x), r"(\S+)$", 1), within(F.regexp_extract(F.trim(x), r"^(\S+)", 1)), none))
    python = F.concat(froms, plain)
    # Go: one import, or a block of them
    blocks = F.concat(text("quoted", r"(?m)^import\s*\(([^)]*)\)", 1), text("quoted", r"(?m)^import[ \t]+([^(\n]+)", 1))
    specs = F.flatten(F.transform(blocks, lambda b: F.filter(F.transform(F.split(b, "[\n;]"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike('^(?:[\\w.]+[ \\t]+)?"[^"]+"$'))))
    own = lambda p: F.regexp_extract(F.regexp_replace(p, r"/v[0-9]+$", ""), r"([^/]+)$", 1)
    go = F.transform(specs, lambda s: pair(F.when(s.startswith('"'), own(F.regexp_extract(s, '"([^"]+)"', 1))).otherwise(F.replace(F.regexp_extract(s, r"^(\S+)", 1), F.lit("."), F.lit(""))), F.regexp_extract(s, '"([^"]+)"', 1), none))
    # scripts: import a, {b as c}, * as d from './x'; export {a as b} from './x'; const a = require('./x')
    clause = r"""(?m)^[ \t]*(?:import|export)\s+([^'"`;]*?)\s*from\s*['"](\.[^'"\n]*)['"]"""
    near = lambda p: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(_normal(F.concat(place, F.lit("/"), p)), r"\.(?:[mc]?[jt]s|[jt]sx)$", ""), "(?:^|/)index$", ""), F.lit("")), F.when(_normal(F.concat(place, F.lit("/"), p)).isNotNull(), "."))
    star = lambda c: F.regexp_extract(c, rf"\*\s*as\s+({NAME})", 1)
    default = lambda c: F.regexp_extract(c, rf"^(?:type\s+)?({NAME})\s*(?:,|$)", 1)
    braced = lambda c: F.regexp_extract(c, r"\{([^}]*)\}", 1)
    from_clause = lambda c, p: F.concat(names(braced(c), near(p), "as"), F.filter(F.array(pair(star(c), near(p), none), pair(default(c), near(p), default(c)), pair(F.when(F.trim(c) == "*", "*").otherwise(""), near(p), none)), lambda x: x["alias"] != ""))
    required = rf"""(?m)^[ \t]*(?:const|let|var)\s+(\{{[^}}]*\}}|{NAME})\s*=\s*require\(\s*['"](\.[^'"\n]*)['"]"""
    needs = F.flatten(F.zip_with(text("quoted", required, 1), text("quoted", required, 2), lambda c, p: F.when(c.startswith("{"), names(F.replace(c, F.lit(":"), F.lit(" as ")), near(p), "as")).otherwise(F.array(pair(c, near(p), none)))))
    script = F.concat(F.flatten(F.zip_with(text("quoted", clause, 1), text("quoted", clause, 2), from_clause)), needs)
    read = scan.select("repo", "path", "lang", F.explode(F.when(F.col("lang") == "python", python).when(F.col("lang") == "go", go).otherwise(script)).alias("i")).select("repo", "path", "lang", F.when(F.col("i.alias") != "*", F.col("i.alias")).otherwise("").alias("alias"), "i.target", "i.name").where("target IS NOT NULL AND NOT (lang = 'go' AND alias = '_')")
    # a Go path is within the repository if it begins with one of its modules: the longest counts
    steps = F.split("target", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.struct(F.array_join(F.slice(steps, 1, n), "/").alias("module"), F.array_join(F.slice(steps, n + 1, F.size(steps)), "/").alias("below")))
    hits = read.where("lang = 'go'").withColumn("p", F.explode(prefixes)).select("*", "p.module", "p.below").join(modules, ["repo", "module"])
    inside = hits.groupBy("repo", "path", "alias", "target", "name").agg(F.max_by(F.struct("folder", "below"), F.length("module")).alias("b"))
    folder = F.coalesce(F.nullif(F.array_join(F.filter(F.array("b.folder", "b.below"), lambda x: x != ""), "/"), F.lit("")), F.lit("."))
    others = read.where("lang <> 'go'").select("repo", "path", "alias", F.col("target").alias("unit"), "name")
    return others.unionByName(inside.select("repo", "path", "alias", folder.alias("unit"), "name")).distinct()


def go_modules(files: DataFrame) -> DataFrame:
    """repo, module and folder of each go.mod. files: repo, path, content."""
    mods = files.where(F.col("path").rlike(r"(?:^|/)go\.mod$")).select("repo", F.regexp_extract("content", r"(?m)^module[ \t]+\"?([^\s\"]+)", 1).alias("module"), _folder(F.col("path")).alias("folder"))
    return mods.where("module <> ''").groupBy("repo", "module").agg(F.min("folder").alias("folder"))


def call_edges(files: DataFrame, rounds: int = 4) -> DataFrame:
    """All calls: repo, path, symbol (the caller; empty: the file), callee, line, how, to_path and to_symbol; one row for each definition that is meant.

    files: repo, path, content, in Go, Python, TypeScript and JavaScript; others and null paths are left out, of a repeated path the
    smallest content counts, a null content is empty. how is file (a definition of that name in the same file, called plainly or through self or this), scope (the same Go package),
    import (through what the file imports, also where that imports it in turn, up to rounds times) or null: not resolved, with null targets. Calls
    through values need types and are not resolved.
    """
    scan = written(scanned(files), "scanned")
    lined = written(lines(scan), "lines")
    defs = definitions(lined).withColumn("unit", unit(F.col("path")))
    brought = written(imports(scan, go_modules(files)), "imports")
    every = calls(lined)
    # names are looked up once for each file and callee
    asked = written(every.select("repo", "path", "callee").distinct(), "callees")
    last = F.element_at(F.split("callee", r"\."), -1)
    plainly = ~F.col("callee").contains(".") | F.col("callee").rlike(rf"^(?:self|this|cls)\.{NAME}$")
    short = defs.select("repo", "path", F.element_at(F.split("symbol", r"\."), -1).alias("last"), "symbol")
    same = asked.where(plainly).withColumn("last", last).join(short, ["repo", "path", "last"]).select("repo", "path", "callee", F.lit("file").alias("how"), F.col("path").alias("to_path"), F.col("symbol").alias("to_symbol"))
    # what a unit offers by name: its definitions, and in rounds what its files import by name
    offers = defs.select("repo", "unit", F.col("symbol").alias("name"), F.col("path").alias("to_path"), F.col("symbol").alias("to_symbol"))
    relay = brought.where(family(F.col("path")) != "go").withColumn("to", unit(F.col("path")))
    fresh = offers
    for n in range(rounds):
        o = fresh.select("repo", "unit", F.col("name").alias("offered"), F.split("name", r"\.")[0].alias("head"), "to_path", "to_symbol")
        named = relay.where("name IS NOT NULL").join(o, (relay.repo == o.repo) & (relay.unit == o.unit) & (F.col("name") == F.col("head"))).select(relay.repo, F.col("to").alias("unit"), F.concat("alias", F.substring("offered", F.length("head") + 1, F.length("offered"))).alias("name"), "to_path", "to_symbol")
        starred = relay.where("name IS NULL AND alias = ''").join(o, (relay.repo == o.repo) & (relay.unit == o.unit)).select(relay.repo, F.col("to").alias("unit"), F.col("offered").alias("name"), "to_path", "to_symbol")
        fresh = written(named.unionByName(starred).distinct().join(offers, ["repo", "unit", "name", "to_path", "to_symbol"], "left_anti"), f"offers{n}")
        offers = offers.unionByName(fresh)
        if fresh.isEmpty():
            break
    # the file's own scope: by name, by all names, or a unit under an alias of one or more parts
    pieces = F.split("callee", r"\.")
    splits = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.struct(F.array_join(F.slice(pieces, 1, n), ".").alias("alias"), F.array_join(F.slice(pieces, n + 1, F.size(pieces)), ".").alias("below")))
    open_ = asked.join(same.select("repo", "path", "callee").distinct(), ["repo", "path", "callee"], "left_anti")
    parts = open_.select("repo", "path", "callee", F.explode(splits).alias("s")).select("repo", "path", "callee", "s.alias", "s.below")
    through = parts.join(brought.where("alias <> ''"), ["repo", "path", "alias"])
    # a name from a package may be one of its modules
    wanted = F.explode(F.array_distinct(F.array(
        F.struct("unit", F.array_join(F.filter(F.array("name", "below"), lambda x: x.isNotNull() & (x != "")), ".").alias("name"), F.length("alias").alias("size")),
        F.struct(F.when(F.col("unit") == ".", F.col("name")).otherwise(F.concat_ws("/", "unit", "name")).alias("unit"), F.col("below").alias("name"), F.length("alias").alias("size")),
    )))
    keyed = through.select("repo", "path", "callee", wanted.alias("w")).select("repo", "path", "callee", "w.*").withColumn("how", F.lit("import"))
    spread = open_.join(brought.where("alias = ''").select("repo", "path", "unit").distinct(), ["repo", "path"]).select("repo", "path", "callee", "unit", F.col("callee").alias("name"), F.lit(0).alias("size"), F.lit("import").alias("how"))
    package = open_.where(family(F.col("path")) == "go").select("repo", "path", "callee", unit(F.col("path")).alias("unit"), F.col("callee").alias("name"), F.lit(0).alias("size"), F.lit("scope").alias("how"))
    met = keyed.unionByName(spread).unionByName(package).where("name <> ''").join(offers, ["repo", "unit", "name"])
    met = met.where(family(F.col("path")) == family(F.col("to_path")))
    best = met.groupBy("repo", "path", "callee").agg(F.max("size").alias("size"))
    found = met.join(best, ["repo", "path", "callee", "size"]).select("repo", "path", "callee", "how", "to_path", "to_symbol").distinct()
    meant = same.unionByName(found)
    out = every.join(meant, ["repo", "path", "callee"], "left")
    # a symbol that calls its own name gives no edge, but is no unresolved call either
    return out.where(~F.coalesce((F.col("path") == F.col("to_path")) & (F.col("symbol") == F.col("to_symbol")), F.lit(False))).select("repo", "path", "symbol", "callee", F.col("line").cast("long").alias("line"), "how", "to_path", "to_symbol")


def import_edges(files: DataFrame) -> DataFrame:
    """repo, path and to_unit: the folders (Go) and files or folders (others) of the same repository that a file imports, but its own."""
    scan = scanned(files)
    have = scan.select("repo", unit(F.col("path")).alias("to_unit")).distinct()
    brought = imports(scan, go_modules(files))
    member = F.when(F.col("name").isNotNull(), F.when(F.col("unit") == ".", F.col("name")).otherwise(F.concat_ws("/", "unit", "name")))
    either = brought.select("repo", "path", F.explode(F.array_compact(F.array("unit", F.when(family(F.col("path")) == "python", member)))).alias("to_unit"))
    return either.join(have, ["repo", "to_unit"]).where(F.col("to_unit") != unit(F.col("path"))).select("repo", "path", "to_unit").distinct()
