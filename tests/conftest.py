import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spindrift.session import build_session, shared_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 8, "spindrift-tests")
    shared_dir(session)
    yield session
    session.stop()
