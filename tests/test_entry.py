"""The entry module without the llm subpackage: the rest still imports, and no query of it is named."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder):
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    assert said.returncode == 0, said.stderr
    return [line.split() for line in said.stdout.splitlines()[-2:]]


def test_entry_without_the_subpackage(tmp_path):
    for gone in (("llm",), ("llm", "corpus_pipeline.py")):
        copy = tmp_path / "-".join(gone)
        shutil.copytree(ROOT, copy, ignore=lambda _, found, gone=gone: [x for x in found if x in (*gone, ".git", "__pycache__")])
        queries, sql = names(copy)
        assert "phrases_default" in queries and not [q for q in [*queries, *sql] if q.startswith("op") or q == "pipeline"]
