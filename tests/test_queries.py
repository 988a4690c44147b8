"""Every registered query against its SQL on the smallest given tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import differences, spark_result
from tests.conftest import FOLDER

SQL = oracle_sql()


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    if name in SQL:
        assert differences(spark, duck, FOLDER, name) is None
    else:
        assert spark_result(spark, FOLDER, name)[1]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(queries())


def test_entry(spark):
    out = entry(spark)
    assert out.count() > 0 and "claim_pct" in out.columns
