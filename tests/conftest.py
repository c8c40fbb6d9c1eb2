import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from changeflow import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cpus=4)
    yield session
    session.stop()


@pytest.fixture
def at():
    """Hours after a fixed start."""
    start = datetime(2024, 1, 1)
    return lambda hours=0.0: start + timedelta(hours=hours)
