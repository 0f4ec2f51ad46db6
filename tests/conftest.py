import pytest

from pathtide.testing import spark_session


@pytest.fixture(scope="session")
def spark():
    return spark_session(partitions=2)
