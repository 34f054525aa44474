import pytest


@pytest.fixture(scope="session")
def spark():
    from duolex.functions.session import session

    made = session("tests", cores=4)
    yield made
    made.stop()
