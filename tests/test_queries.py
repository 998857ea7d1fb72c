"""Every query of the relational part against its DuckDB SQL."""

import pytest

import __spark_entry__ as entry
from sparkloft.plans import catalog
from tests.compare import compare

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    assert compare(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE_SQL[name], SMALL) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("parts", [1, 8])
def test_sums_do_not_depend_on_partitions(spark, parts, tmp_path):
    spark.read.parquet(f"{SMALL}/lineitem.parquet").repartition(parts).write.parquet(f"{tmp_path}/lineitem.parquet")
    again = catalog.QUERIES["pricing_summary"](spark, str(tmp_path)).collect()
    assert sorted(again) == sorted(catalog.QUERIES["pricing_summary"](spark, SMALL).collect())
