import pytest

from webloom.session import local_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = local_session("webloom-tests", "4")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    return session
