import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests", 4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
