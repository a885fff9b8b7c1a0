from millrace.functions.lexer import without_remarks
from millrace.operators.symbols import call_edges, import_edges

PYTHON = {
    "app/main.py": '''"""from app.core import fake
"""
from app.core import run as go, Store
from .util import (
    clean,  # from x import y
    helper as h,
)
import app.util as u, os
import app.deep.inner


def main(x=h()):
    go(clean(x))  # hidden()
    u.clean("call()")
    s = Store.open()
    s.close()
    os.getenv("A")
    app.deep.inner.deepest()

    def nested():
        main()
        local()


class Local(Base):
    limit = h()

    @property
    def one(self):
        return self.two(
            1
        )

    def two(self):
        helper()


def local():
    main()
    Local.one()


main()
''',
    "app/core.py": "from app.util import clean as run\n\nclass Store:\n    def open(cls):\n        pass\n",
    "app/util.py": "def clean(x):\n    return x\n\ndef helper():\n    pass\n",
    "app/deep/__init__.py": "from app.deep.inner import *\n",
    "app/deep/inner.py": "from ..util import clean\ndef deepest():\n    clean(1)\n",
    "tools.py": "from app import deep\nfrom app.deep import deepest\n\nx = deepest() + deep.deepest() + gone()\n",
}
GO = {
    "go.mod": "module example.com/shop // v1\n\ngo 1.22\n",
    "cmd/main.go": 'package main\n\nimport (\n\t"fmt"\n\tc "example.com/shop/internal/cart" // alias\n\t"example.com/shop/pay/v2"\n)\n\nfunc main() {\n\tfmt.Println(`c.Add()`)\n\tc.Add(start())\n\tpay.Do()\n}\n',
    "cmd/start.go": "package main\n\nfunc start() int {\n\treturn start()\n}\n",
    "internal/cart/cart.go": "package cart\n\ntype Cart struct {\n}\n\nfunc (c *Cart) Add(n int) { total(n) }\n\nfunc Add(n int) {\n\ttotal(n)\n}\n\nfunc total(n int) int {\n\treturn n\n}\n",
    "pay/v2/pay.go": "package pay\n\nfunc Do() {}\n",
}
SCRIPT = {
    "web/app.ts": "import React, { useX } from 'react';\nimport { add as plus, type Kind } from './lib/math';\nimport * as api from \"../web/lib\";\nconst { load } = require('./load.js');\n\nexport const start = async (n: number) => {\n  plus(api.add(n));\n  load();\n};\n\nexport class Page extends Base {\n  render() {\n    this.draw(`add()`);\n    if (x) {\n      start(1);\n    }\n  }\n\n  draw(s) {\n    useX();\n  }\n}\n",
    "web/lib/math.ts": "export function add(a) { return a; }\n",
    "web/lib/index.ts": "export { add } from './math';\n",
    "web/load.js": "function load() {}\nmodule.exports = { load };\n",
}


def table(spark, trees):
    return spark.createDataFrame([(r, p, c) for r, tree in trees.items() for p, c in tree.items()], "repo string, path string, content string")


def test_lines_stay_without_remarks():
    code, quoted = without_remarks("a('x\\'y') # z\n'''p\nq''' + b", "python")
    assert code.count("\n") == quoted.count("\n") == 2 and "x" not in code and "z" not in quoted and "q" not in quoted and "'x\\'y'" in quoted


def test_calls_by_scope(spark):
    rows = call_edges(table(spark, {"p": PYTHON, "g": GO, "s": SCRIPT})).collect()
    got = {(r.repo, r.path, r.symbol, r.callee, r.line): (r.how, r.to_path, r.to_symbol) for r in rows}
    assert len(got) == len(rows)
    at = lambda repo, path: {k[2:]: v for k, v in got.items() if k[:2] == (repo, path)}
    no, util = (None, None, None), "app/util.py"
    assert at("p", "app/main.py") == {
        ("main", "h", 12): ("import", util, "helper"), ("main", "go", 13): ("import", util, "clean"), ("main", "clean", 13): ("import", util, "clean"), ("main", "u.clean", 14): ("import", util, "clean"),
        ("main", "Store.open", 15): ("import", "app/core.py", "Store.open"), ("main", "s.close", 16): no, ("main", "os.getenv", 17): no, ("main", "app.deep.inner.deepest", 18): ("import", "app/deep/inner.py", "deepest"),
        ("main", "nested", 20): no, ("main", "local", 22): ("file", "app/main.py", "local"),
        ("Local", "h", 26): ("import", util, "helper"), ("Local.one", "self.two", 30): ("file", "app/main.py", "Local.two"), ("Local.two", "helper", 35): no,
        ("local", "main", 39): ("file", "app/main.py", "main"), ("local", "Local.one", 40): no, ("", "main", 43): ("file", "app/main.py", "main"),
    }
    assert at("p", "app/deep/inner.py") == {("deepest", "clean", 3): ("import", util, "clean")}
    assert at("p", "tools.py") == {("", "deepest", 4): ("import", "app/deep/inner.py", "deepest"), ("", "deep.deepest", 4): ("import", "app/deep/inner.py", "deepest"), ("", "gone", 4): no}
    cart = "internal/cart/cart.go"
    assert at("g", "cmd/main.go") == {("main", "fmt.Println", 10): no, ("main", "c.Add", 11): ("import", cart, "Add"), ("main", "start", 11): ("scope", "cmd/start.go", "start"), ("main", "pay.Do", 12): ("import", "pay/v2/pay.go", "Do")}
    assert at("g", cart) == {("Cart.Add", "total", 6): ("file", cart, "total"), ("Add", "total", 9): ("file", cart, "total")} and not at("g", "cmd/start.go")
    math = ("import", "web/lib/math.ts", "add")
    assert at("s", "web/app.ts") == {
        ("", "require", 4): no, ("start", "plus", 7): math, ("start", "api.add", 7): math, ("start", "load", 8): ("import", "web/load.js", "load"),
        ("Page.render", "this.draw", 13): ("file", "web/app.ts", "Page.draw"), ("Page.render", "start", 15): ("file", "web/app.ts", "start"), ("Page.draw", "useX", 20): no,
    }


def test_imports_within_the_repository(spark):
    got = {tuple(r) for r in import_edges(table(spark, {"p": PYTHON, "g": GO, "s": SCRIPT})).collect()}
    assert got == {
        ("p", "app/main.py", "app/core"), ("p", "app/main.py", "app/util"), ("p", "app/main.py", "app/deep/inner"), ("p", "app/core.py", "app/util"), ("p", "app/deep/__init__.py", "app/deep/inner"),
        ("p", "app/deep/inner.py", "app/util"), ("p", "tools.py", "app/deep"), ("g", "cmd/main.go", "internal/cart"), ("g", "cmd/main.go", "pay/v2"), ("s", "web/app.ts", "web/lib/math"), ("s", "web/app.ts", "web/lib"), ("s", "web/app.ts", "web/load"), ("s", "web/lib/index.ts", "web/lib/math"),
    }


def test_nothing_empty_repeated_and_other_files(spark):
    assert call_edges(table(spark, {})).collect() == [] and import_edges(table(spark, {})).collect() == []
    files = spark.createDataFrame([("r", "a.py", None), ("r", "b.txt", "f()"), ("r", None, "f()"), ("r", "c.py", "z()\n"), ("r", "c.py", "f()\n"), ("r", "c.py", "f()\n"), (None, "d.py", "g()")], "repo string, path string, content string")
    assert sorted((r.path, r.callee, r.how) for r in call_edges(files.withColumn("line", files.path)).collect()) == [("c.py", "f", None), ("d.py", "g", None)]
