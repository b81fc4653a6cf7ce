"""Every query that has SQL, against DuckDB on the smallest tables."""

import subprocess
import sys

import pytest

from tests.conftest import SF, rows, sql_rows
from wayfold.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    columns, expected = sql_rows(registry.ORACLES[name])
    assert sorted(df.columns) == columns
    assert rows(df) == expected


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_works_without_the_optional_folders():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "wayfold.llm" or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert set(e.queries()) == set(e.oracle_sql()) and len(e.queries()) > 30
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_scans_are_pruned(spark):
    plan = registry.QUERIES["q17_json_extract"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,props:string>" in plan
