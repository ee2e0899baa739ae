import pytest

from brookfern.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
