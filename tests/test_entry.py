"""The entry module with and without the subpackage that a checkout may lack."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROBE = """
import __spark_entry__ as e, bench
q, s = e.queries(), e.oracle_sql()
print(len(q), len([k for k in q if k[0] == "q"]), "pipeline" in q, set(s) <= set(q))
"""


def probe(folder):
    run = subprocess.run([sys.executable, "-c", PROBE], cwd=folder, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": ""})
    assert run.returncode == 0, run.stderr
    return run.stdout.split()[-4:]


@pytest.mark.parametrize("gone", [(), ("veriseam/llm", "tests/llm"), ("veriseam/llm", "tests/llm", "corpus_pipeline.py")])
def test_queries_stand_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.parquet"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    had = (copy / "veriseam/llm").is_dir()
    total, core, pipeline, sql = probe(copy)
    from veriseam.plans import catalogue

    assert int(core) == len(catalogue.QUERIES) and sql == "True"
    assert pipeline == str(had) and (int(total) > int(core)) == had
