import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_queries_have_oracles():
    missing = [k for k in entry.queries() if k not in entry.oracle_sql() and not k.startswith("op") and k != "pipeline"]
    assert not missing


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["exchange", "symbol", "timestamp", "open", "high", "low", "close", "volume"] and df.count() > 0
