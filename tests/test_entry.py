"""The entry points without the training part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LLM = os.path.join("veilframe", "llm")
SHOW = "import __spark_entry__ as e; print(sorted(set(e.queries()) | set(e.oracle_sql())))"


@pytest.mark.parametrize("without", [(LLM,), (LLM, "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_queries_without_the_training_part(tmp_path, without):
    tree = tmp_path / "tree"
    shutil.copytree(ROOT, tree, ignore=lambda d, names: {
        n for n in names
        if n in (".git", "__pycache__") or os.path.relpath(os.path.join(d, n), ROOT) in without
    })
    done = subprocess.run(
        [sys.executable, "-B", "-c", SHOW], cwd=tree, capture_output=True, text=True, timeout=120,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
    )
    assert done.returncode == 0, done.stderr
    names = done.stdout.rpartition("[")[2]
    assert "'term_table_scan'" in names and "'pipeline'" not in names
    assert ("'op4_exact_dedup'" in names) == (LLM not in without and os.path.isdir(os.path.join(ROOT, LLM)))
