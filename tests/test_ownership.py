import fnmatch
import random
import re

from millrace.operators.ownership import file_owners, owner_edges, rules

TEXT = """# everything
*       @acme/core   # fallback
*.js    @acme/web
/docs/  @writer docs@acme.io

[Section]
build   @acme/build
/src/*  @acme/src
/src/**/test_*.py @acme/test
lib/**  @acme/lib
/docs/internal/
**/gen/*.go @bot
"""


def owners(spark, paths, text=TEXT, place=".github/CODEOWNERS"):
    known = rules(spark.createDataFrame([("r", place, text), ("r", "other/CODEOWNERS", "* @no")], "repo string, path string, content string"))
    rows = file_owners(spark.createDataFrame([("r", p) for p in paths], "repo string, path string"), known).collect()
    return {r.path: (None if r.owners is None else list(r.owners), r.pattern) for r in rows}


def test_last_rule_that_fits(spark):
    got = owners(spark, ["README", "a/b.js", "docs/x/y.md", "x/docs/y", "x/build/z.js", "build", "src/a.c", "src/b/a.c", "src/b/test_a.py", "src/test_a.py", "lib/a/b", "docs/internal/p", "a/gen/x.go", "gen/x.go", "a/gen/b/x.go", "builds/a"])
    assert {k: v[1] for k, v in got.items()} == {
        "README": "*", "a/b.js": "*.js", "docs/x/y.md": "/docs/", "x/docs/y": "*", "x/build/z.js": "build", "build": "build", "src/a.c": "/src/*", "src/b/a.c": "*", "src/b/test_a.py": "/src/**/test_*.py", "src/test_a.py": "/src/**/test_*.py",
        "lib/a/b": "lib/**", "docs/internal/p": "/docs/internal/", "a/gen/x.go": "**/gen/*.go", "gen/x.go": "**/gen/*.go", "a/gen/b/x.go": "*", "builds/a": "*",
    }
    assert got["docs/x/y.md"][0] == ["@writer", "docs@acme.io"] and got["docs/internal/p"][0] == [] and got["README"][0] == ["@acme/core"]


def test_no_rules_and_other_repositories(spark):
    assert owners(spark, ["a"], "# nothing\n\n[x]\n") == {"a": (None, None)}
    known = rules(spark.createDataFrame([("r", "CODEOWNERS", "* @a"), ("s", "CODEOWNERS", None)], "repo string, path string, content string"))
    got = file_owners(spark.createDataFrame([("r", "x"), ("s", "x"), ("t", "x")], "repo string, path string"), known).collect()
    assert {(r.repo, r.pattern) for r in got} == {("r", "*"), ("s", None), ("t", None)}


def fits(pattern, path):
    """The same by hand: parts of the path against parts of the pattern, at any depth unless a slash fixes it."""
    body = pattern.strip("/")
    want = body.split("/")
    anchored = "/" in pattern.rstrip("/")

    def follow(w, p):
        if not w:
            return not p or not pattern.rstrip("/").endswith("/*") or pattern.endswith("/")
        if w[0] == "**":
            return bool(p) if w == ["**"] else any(follow(w[1:], p[i:]) for i in range(len(p)))
        return bool(p) and re.fullmatch(fnmatch.translate(w[0]), p[0]) is not None and follow(w[1:], p[1:])

    parts = path.split("/")
    for start in [0] if anchored else range(len(parts)):
        if follow(want, parts[start:]) and not (pattern.endswith("/") and start + len(want) == len(parts)):
            return True
    return False


def test_against_every_pattern(spark):
    rng = random.Random(2)
    name = lambda: rng.choice(["a", "b", "lib", "x.py", "y.js"])
    part = lambda: rng.choice([name(), name(), "*", "*.py", "li?"])
    patterns = sorted({rng.choice(["/", ""]) + "/".join(part() for _ in range(rng.randrange(1, 4))) + rng.choice(["", "/"]) for _ in range(60)} | {"a/**", "/lib/**/x.py", "**/b"})
    rng.shuffle(patterns)
    paths = sorted({"/".join(name() for _ in range(rng.randrange(1, 5))) for _ in range(150)})
    got = owners(spark, paths, "\n".join(f"{p} @o" for p in patterns), "CODEOWNERS")
    for path in paths:
        assert got[path][1] == next((p for p in reversed(patterns) if fits(p, path)), None), path


def test_edges(spark):
    known = rules(spark.createDataFrame([("r", "CODEOWNERS", TEXT)], "repo string, path string, content string"))
    got = {(r.subject, r.owner, r.kind, r.line) for r in owner_edges(known).collect()}
    assert got == {("", "@acme/core", "team", 2), ("docs", "@writer", "person", 4), ("docs", "docs@acme.io", "person", 4), ("build", "@acme/build", "team", 7), ("src", "@acme/src", "team", 8), ("lib", "@acme/lib", "team", 10)}
