import pytest

from noticeworks.plans.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
