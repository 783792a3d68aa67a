import pytest

from lamina.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", "4g", 4)
    yield session
    session.stop()
