"""The library without the corpus operators still imports, and registers everything else."""

import re
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_names_match():
    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracles) <= set(queries)
    assert "usage_series" in queries


def test_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*sorted(e.queries()))"], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")})
    assert out.returncode == 0, out.stderr
    assert set(out.stdout.split()) == {q for q in __spark_entry__.queries() if not (q[:2] == "op" and q[2:3].isdigit()) and q != "pipeline"}


def test_nothing_else_imports_them():
    for f in (ROOT / "millrace").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text()), f  # as a word of its own: fullmatch holds it, too
