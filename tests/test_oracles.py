"""Every query with a SQL check, compared at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from verify import compare, connect


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_query_matches_sql(spark, sf, duck, name):
    got = queries()[name](spark, sf).toPandas()
    assert compare(got, duck.execute(oracle_sql()[name]).df()).startswith("ok")


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 10 and rows[0]["seuil_min"] == 0.1


def test_run_record(spark, sf):
    row = queries()["S13_S14_S15_E8_run_record"](spark, sf).first()
    assert row["model_name"] == "camembert-base" and row["max_length"] == 384 and row["report_lines"] == 7 and row["timed"] and row["stamped"]
