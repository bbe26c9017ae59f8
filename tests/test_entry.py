"""The driver's entry with and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), sorted(n for n in q if n.startswith('op') or n == 'pipeline'))"


@pytest.mark.parametrize("left", ["pipeline", "empty folder", "nothing"])
def test_queries_without_the_subpackage(tmp_path, left):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    if left == "empty folder":
        (copy / "tessera/llm/__pycache__").mkdir(parents=True)
    if left == "nothing":
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    done = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    number, names = done.stdout.split(" ", 1)
    assert int(number) > 50 and names.strip() == "[]"
