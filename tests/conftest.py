import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from keyspan.session import local_session

    session = local_session(
        4, 4, spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("work")),
    )
    yield session
    session.stop()


@pytest.fixture
def place(tmp_path):
    """A fresh path below the test's own folder."""
    made = []

    def new(name: str = "out") -> str:
        made.append(name)
        return str(tmp_path / f"{name}-{len(made)}")

    return new
