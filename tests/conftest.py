import pytest

from equipoise.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "3g", 4)
    yield session
    session.stop()
