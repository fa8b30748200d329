from __future__ import annotations

import pytest

from __spark_entry__ import entry, queries
from check import compare, connect
from gazette.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
BATCH = [name for name in QUERIES if not name.startswith("stream_")]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", BATCH)
def test_query_equals_sql(spark, duck, name, capsys):
    assert compare(spark, duck, SF, name).startswith("ok")
    queries()[name](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A window or an aggregate by key may never need all rows in one partition.
    lines = plan.splitlines()
    assert not any("Exchange SinglePartition" in line and "Window" in lines[i - 2] for i, line in enumerate(lines))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["url_hash", "url", "title", "publisher", "published"] and rows.count() == 100
