"""Every registered query on the smallest tables, against its SQL twin where it has one."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    frame = queries()[name](spark, SF_DIR)
    if name in oracle_sql():
        assert difference(frame, con, oracle_sql()[name]) is None
    else:
        assert frame.count() > 0


def test_entry(spark):
    frame = entry(spark)
    assert frame.count() > 0
    assert frame.columns[:3] == ["window_start", "window_end", "org_id"]
