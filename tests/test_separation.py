"""The business-table library stands without the training-data operators: a copy of the repository
that lacks their folders (and, in turn, the pipeline) still imports and registers its queries."""

import os
import shutil
import subprocess
import sys

import pytest

from bizlens.plans.queries import REGISTRY

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def copy_without(target, *left_out):
    def skip(folder, names):
        rel = os.path.relpath(folder, ROOT)
        return [n for n in names if n in {".git", "__pycache__", ".pytest_cache"}
                or os.path.normpath(os.path.join(rel, n)) in left_out]
    shutil.copytree(ROOT, target, ignore=skip)


@pytest.mark.parametrize("left_out", [
    ("bizlens/llm", "tests/llm"), ("bizlens/llm", "tests/llm", "corpus_pipeline.py")])
def test_rest_imports_without_the_subpackage(tmp_path, left_out):
    copy = tmp_path / "copy"
    copy_without(copy, *left_out)
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=copy, capture_output=True, text=True, timeout=120,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr
    n, n_sql, pipeline = done.stdout.split()
    assert int(n) == len(REGISTRY) and pipeline == "False"


def test_nothing_else_imports_the_subpackage():
    found = []
    for folder, _, names in os.walk(os.path.join(ROOT, "bizlens")):
        if os.path.relpath(folder, ROOT).startswith(os.path.join("bizlens", "llm")):
            continue
        for n in names:
            if n.endswith(".py"):
                text = open(os.path.join(folder, n), encoding="utf-8").read()
                if "bizlens.llm" in text or "from .llm" in text or "from ..llm" in text:
                    found.append(os.path.join(folder, n))
    assert not found
