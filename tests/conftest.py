import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from recordloom.session import build_session

    root = tmp_path_factory.mktemp("shared")
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(root),
            "spark.sql.warehouse.dir": str(root / "warehouse"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Texts to a frame of numbered lines."""

    def make(texts, file="f"):
        rows = [(file, i + 1, t) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "file string, line_no bigint, value string")

    return make


@pytest.fixture
def records(lines):
    from recordloom.sources.records import records_of

    return lambda texts, **kw: records_of(lines(texts), **kw)
