import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from quire.session import build

    session = build("tests", "local[4]", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
