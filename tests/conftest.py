import pytest

from fathom.session import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{shared}", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("ERROR")
    return s
