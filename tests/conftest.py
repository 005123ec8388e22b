import tempfile

import pytest

from caseloom.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp"),
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
