from __future__ import annotations

import pytest

from gazette.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("gazette-tests", "local[8]", {
        "spark.sql.shuffle.partitions": "4", "spark.gazette.parse.partitions": "8", "spark.driver.memory": "6g", "spark.sql.adaptive.enabled": "true",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def store(spark, tmp_path):
    from gazette.sources.tables import Store

    return Store(spark, str(tmp_path / "store"), digits=1)
