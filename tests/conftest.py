import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import local_session, tune  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = tune(local_session("4", partitions=4, memory="4g"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def study(spark):
    from tidemark.sources.views import Study

    return Study(spark, SF)


@pytest.fixture(scope="session")
def con():
    from check import duck

    return duck(SF)
