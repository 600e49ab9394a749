import pytest


@pytest.fixture(scope="session")
def spark():
    from tessera.session import local_session

    return local_session("8", 4, "4g")
