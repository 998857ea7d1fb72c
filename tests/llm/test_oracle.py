"""Queries with DuckDB SQL give its rows."""

import pytest

from sparkloft.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare

MIDDLE = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query(spark, name):
    assert compare(QUERIES[name](spark, MIDDLE), ORACLE_SQL[name], MIDDLE) > 0
