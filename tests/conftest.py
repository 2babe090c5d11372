import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session, ready_workers

    session = local_session(4, partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield ready_workers(session)
    session.stop()
