"""The rest of the library does not need the training-data subpackage."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", "__pycache__", ".git", "tests")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), set(q) == set(e.oracle_sql()), any(n.startswith('op') for n in q))"
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")}, capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
    assert ran.stdout.split()[1:] == ["True", "False"]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "bazaarlens").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "bazaarlens.llm" not in path.read_text(), path
