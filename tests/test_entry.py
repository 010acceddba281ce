"""The entry file in processes of its own: without a session, and without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT

COUNT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"


@pytest.mark.parametrize("gone", [[], ["estimark/llm"], ["estimark/llm", "corpus_pipeline.py"]])
def test_queries_without_a_session(tmp_path, gone):
    for name in ("estimark", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", *[os.path.basename(g) for g in gone]))
        elif os.path.exists(source) and name not in gone:
            shutil.copy(source, tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, sql, llm = done.stdout.split()
    assert int(n) >= int(sql) > 0 and (llm == "False" if gone else True)
