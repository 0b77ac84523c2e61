"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

from tidewell.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert [p for p in compare(name, df, con, ORACLES[name]) if p != "no rows"] == []
    else:
        assert df.count() > 0
