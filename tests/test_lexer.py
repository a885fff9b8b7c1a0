import pytest

from millrace.functions.lexer import significant, significant_key
from millrace.operators.changes import triage
from pyspark.sql import functions as F

#: Pairs that differ in comments, blanks and wording only.
SAME = [
    ("go", 'x := f("a") // one\n', 'x :=\tf("b b") /* two\n */\n'),
    ("go", "var s = `raw // no comment`\nfunc f() {}", "var s = `other\nlines`\n\n// doc\nfunc f() {\n}"),
    ("java", 'String s = """\n text "quoted" """; // c', 'String s = "t";'),
    ("python", 'def f(a):\n    """Says."""\n    return a  # c\n', "def f(a):\n\n    return a\n"),
    ("python", "if a:\n  b()\n", "if a:\n        b()   # wider\n"),
    ("python", "x = f(1,\n      2)\n", "x = f(1, 2)\n"),
    ("python", 'x = r"\\d" + \'it\\\'s\'', 'x = "" + ""'),
    ("typescript", "const a = `one ${b + c} two`;", "const a = `${b+c}`; // x"),
    ("javascript", "'use strict';\nf('a\\'b')", "f(\"\")"),
    ("rust", "/* a /* nested */ still */ fn f<'a>(x: &'a str) -> char { 'c' }", "fn f<'a>(x: &'a str) -> char { '\\n' }"),
    ("rust", 'let s = r#"a " b"#;', 'let s = "";'),
]
#: Pairs that differ in what matters.
OTHER = [
    ("go", "a + b", "a - b"), ("go", "x := 1", "x := 2"), ("go", 'import "a"', 'import "b"'), ("go", 'import (\n"a"\n)', 'import (\n"b"\n)'), ("go", 'os.Getenv("A")', 'os.Getenv("B")'), ("python", 'os.environ["A"]', 'os.environ["B"]'),
    ("python", "if a:\n    b()\n    c()\n", "if a:\n    b()\nc()\n"), ("python", "from a import b", "from c import b"), ("python", 'f"{a}"', 'f"{b}"'), ("javascript", "require('a')", "require('b')"), ("javascript", "import x from 'a'", "import x from 'b'"),
    ("typescript", "`${a}`", "`${b}`"), ("java", '@Path("/a")\nclass A {}', '@Path("/b")\nclass A {}'), ("rust", 'env!("A")', 'env!("B")'), ("rust", "fn f<'a>()", "fn f<'b>()"), ("go", 'f("a")', 'f("a", "b")'), ("go", "a // b", "a; b"),
]


@pytest.mark.parametrize("language, a, b", SAME)
def test_nothing_that_matters(language, a, b):
    assert significant(a, language) == significant(b, language)


@pytest.mark.parametrize("language, a, b", OTHER)
def test_what_matters(language, a, b):
    assert significant(a, language) != significant(b, language)


def test_open_ends():
    """Texts and comments that never close end with the file or the line, and every file gives tokens."""
    assert significant("a /* b", "go") == ["a"] and significant('a = "b\nc', "java") == ["a", "=", "s", "c"] and significant("/* /* */", "rust") == []
    assert significant('x = """open', "python") == [";", "x", "=", "s"] and significant("", "go") == [] and significant("é := 世界", "go") == ["é", ":", "=", "世界"]
    long = "x = 1\n" * 20_000 + '"' + "a" * 200_000
    assert len(significant(long, "python")) == 80_001 - 1


def test_keys_and_triage(spark):
    rows = [("a.go", "modified", "x := 1 // a", "x := 1"), ("b.go", "modified", "x := 1", "x := 2"), ("c.rb", "modified", "x # a", "x"), ("d.py", "renamed", '"""a"""\nx = 1', "x = 1"), ("e.go", "added", None, "x"), ("f.ts", "renamed", "a", "a ")]
    files = spark.createDataFrame([(*r, 95 if r[0] == "d.py" else 60) for r in rows], "path string, status string, old_text string, new_text string, similarity int")
    files = files.select("*", F.lit(False).alias("binary"), F.md5("old_text").alias("old_hash"), F.md5("new_text").alias("new_hash"))
    got = {r.path: (r.verdict, r.reason) for r in triage(files, []).collect()}
    assert got == {"a.go": ("abort", "same tokens"), "b.go": ("proceed", "changed"), "c.rb": ("proceed", "changed"), "d.py": ("abort", "renamed"), "e.go": ("proceed", "changed"), "f.ts": ("proceed", "moved")}
    keys = files.select("path", significant_key(F.col("path"), F.col("old_text")).alias("k")).collect()
    assert {r.path for r in keys if r.k is None} == {"c.rb", "e.go"}
