import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.sessions import local_session  # noqa: E402
from tidelog.session import prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = prepare(local_session())
    yield session
    session.stop()
