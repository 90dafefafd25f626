import pytest

from tabletext.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", cores=4, spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
