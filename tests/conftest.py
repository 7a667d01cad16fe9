"""One small session for all tests."""

import pytest

from kgloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = build_session("tests", 4, **{"spark.checkpoint.dir": f"file://{folder}", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows to a frame by a schema string."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
