import pytest

from tests.compare import connect
from tests.session import local_session

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(FOLDER)


@pytest.fixture
def rows(spark):
    """rows([(id, text), ...]) -> DataFrame(msg_id, text)"""
    return lambda data: spark.createDataFrame(
        [(i, t) for i, t in enumerate(data)] if not data or not isinstance(data[0], tuple)
        else data, "msg_id bigint, text string")
