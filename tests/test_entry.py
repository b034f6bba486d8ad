"""The driver contract holds with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), 'pipeline' in E.queries())"


@pytest.mark.parametrize("left_out", [("clusterlens/llm",), ("corpus_pipeline.py",), ("clusterlens/llm", "corpus_pipeline.py")])
def test_entry_imports_without_the_subpackage(tmp_path, left_out):
    from clusterlens.plans.catalog import QUERIES

    skipped = [os.path.join(REPO, x) for x in left_out]

    def ignore(folder, names):
        return [n for n in names if n in (".git", "__pycache__", "tests") or os.path.join(folder, n) in skipped]

    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=ignore)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, n_sql, pipeline = out.stdout.split()
    assert int(n) >= len(QUERIES) and int(n_sql) >= len(QUERIES) and pipeline == "False"
