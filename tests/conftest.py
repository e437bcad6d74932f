import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from zoneflow.session import build_session, ship_code  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "zoneflow-tests",
        **{"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4",
           "spark.driver.memory": "6g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    ship_code(session)
    yield session
    session.stop()
