"""Every registered query against its SQL statement on the smallest tables; no plan may hold a
cross product."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evidra.catalog import load_all
from tools.check_oracle import compare, connect

QUERIES = load_all()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(name, spark, con, sf):
    result = compare(QUERIES[name], spark, con, sf)
    assert not result.startswith("MISMATCH"), result



def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "status" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
