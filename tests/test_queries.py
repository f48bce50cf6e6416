"""Every query runs against its SQL check on the smallest data folder.

By default one query per operator family and a spread of the rest run; FULL=1 runs them all.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
CHECKS = entry.oracle_sql()
KEYS = sorted(CHECKS)
if os.environ.get("FULL") != "1":
    KEYS = KEYS[::6]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", KEYS)
def test_matches_sql(spark, con, name):
    compare(entry.queries()[name](spark, FOLDER), con, CHECKS[name])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "player_name" in df.columns


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(entry.queries())


@pytest.mark.parametrize("pipeline_stays", [True, False])
def test_imports_without_the_optional_subpackage(tmp_path, pipeline_stays):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/touchline", tmp_path / "touchline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if pipeline_stays and os.path.exists(f"{root}/corpus_pipeline.py"):
        shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    own = [k for k in entry.queries() if not k.startswith("op") and k != "pipeline"]
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(own)), str(sum(k in CHECKS for k in own))]
