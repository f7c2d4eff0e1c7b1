"""The repository without the corpus subpackage: the entry imports and the other queries run."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert "top_users" in names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
from quarry import session
spark = session.build("isolation", master="local[1]")
assert e.queries()["top_users"](spark, "/root/testdata/sf0.001").count() == 10
"""


def test_without_the_corpus_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    assert not (copy / "quarry/llm").exists() and not (copy / "tests/llm").exists()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(copy)}
    subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, check=True, timeout=300)
