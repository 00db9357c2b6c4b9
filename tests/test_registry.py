"""Every registered query against its SQL on the smallest data folder."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as contract
from siteroster.registry import entries
from tests.oracle import compare, connect

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
ENTRIES = entries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", ENTRIES)
def test_query_equals_sql(spark, con, name):
    query, sql = ENTRIES[name]
    assert compare(spark, con, name, query, sql, SF) == ""


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns


def test_all_else_works_without_the_training_data_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    script = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", script], cwd=copy, capture_output=True, text=True, check=True).stdout
    assert out.split() == [str(len(ENTRIES)), str(sum(sql is not None for _, sql in ENTRIES.values())), "False"]
