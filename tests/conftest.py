import tempfile

import pytest

from prumo.session import build_session


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="prumo-tests-", dir="/tmp")
    session = build_session(
        "local[8]",
        "prumo-tests",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": folder,
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
