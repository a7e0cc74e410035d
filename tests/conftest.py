import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from plumbline.session import local_session  # noqa: E402

TESTDATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "plumbline-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    if not TESTDATA.is_dir():
        pytest.skip("test tables are not here")
    return str(TESTDATA)
