"""Every registered query against DuckDB on the smallest tables.

The session zone is not UTC here, so results must not depend on it.
"""

import importlib.util

import duckdb
import pytest

from conftest import ROOT

import __spark_entry__ as entry

spec = importlib.util.spec_from_file_location("check_oracle", ROOT / "tools" / "check_oracle.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    msg, _, good = check.compare(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert good, msg


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
