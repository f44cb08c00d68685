"""The driver contract with and without the subpackage of training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
NAMES = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q), set(o) - set(q); print(len(q), sorted(k for k in q if k.startswith('op') and '_' in k and k[2].isdigit() or k == 'pipeline'))"


@pytest.mark.parametrize("gone", [["tickloom/llm", "tests/llm"], ["tickloom/llm", "tests/llm", "corpus_pipeline.py"]])
def test_queries_without_the_subpackage(tmp_path, gone):
    to = tmp_path / "copy"
    shutil.copytree(REPO, to, ignore=shutil.ignore_patterns(".git", "__pycache__", *[os.path.basename(g) for g in gone]))
    for name in gone:
        assert not (to / name).exists()
    said = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=to, env={**os.environ, "PYTHONPATH": str(to)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, rest = said.stdout.split(maxsplit=1)
    assert int(n) > 50 and rest.strip() == "[]"
