"""The entry module on copies of the repository without the training-data operators and their pipeline."""

from __future__ import annotations

import pathlib
import shutil
import subprocess
import sys

import pytest

REPO = pathlib.Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("without", [("lakeward/llm", "tests/llm"), ("lakeward/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports_without_parts(tmp_path, without):
    gone = {str(REPO / part) for part in without}

    def skip(folder, names):
        return [n for n in names if n in (".git", "__pycache__") or f"{folder}/{n}" in gone]

    shutil.copytree(REPO, tmp_path / "repo", ignore=skip)
    code = ("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) >= 55; "
            "print(sorted(n for n in q if n == 'pipeline' or n.startswith('op')))")
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    llm = "lakeward/llm" not in without and (REPO / "lakeward/llm").exists()
    assert ("op1_token_counts" in done.stdout) == llm and "pipeline" not in done.stdout.replace("corpus_pipeline", "")
