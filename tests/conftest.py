import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from lorekeep.session import local_session

    session = local_session(4)
    yield session
    session.stop()
