import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lorekeep.session import local_session
    session = local_session(4, shuffle_partitions=4, app="lorekeep-tests")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()
