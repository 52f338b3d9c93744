import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basinlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.log.level": "ERROR", "spark.driver.memory": "4g"},
    )
    yield session
    session.stop()


@pytest.fixture
def folder():
    """A fresh scratch folder per test (left for the system to clear)."""
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")
