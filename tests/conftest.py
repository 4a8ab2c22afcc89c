import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tonequarry.session import local_session, workers_import  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    workers_import(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
