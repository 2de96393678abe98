import pytest

from cloudloom.session import session


@pytest.fixture(scope="session")
def spark():
    return session("4")


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.001"
