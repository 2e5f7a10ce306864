"""Every query that has SQL against it in DuckDB, at the smallest size; COUNTSPARK_SF names another folder."""

import os

import pytest

import __spark_entry__ as entry
import check
from countspark.catalog import ORACLE

SF = os.environ.get("COUNTSPARK_SF", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, name):
    result = check.compare(spark, check.duck(SF), name, SF)
    assert result.startswith("ok"), result


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
