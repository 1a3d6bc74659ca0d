import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from quillspark.session import build_session

    session = build_session("tests", master="local[4]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g",
        "spark.sql.shuffle.partitions": "2",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions on a single row of literals."""
    from pyspark.sql import functions as F

    def run(*columns):
        return tuple(spark.range(1).select(*[F.lit(c) if isinstance(c, str) else c for c in columns]).first())

    return run
