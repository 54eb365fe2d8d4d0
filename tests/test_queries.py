"""Every query against its SQL; those without SQL give rows."""

from __future__ import annotations

import pytest
from oracle import connect, differences

from assayer.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == 200 and all(r["error"] is None for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).where("grp = 'overall'").count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
