import pytest

from lorelink.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return "/root/testdata/sf0.001"
