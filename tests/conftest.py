import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tools.session import local_session

    session = local_session(cpus="4", partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def views(spark):
    from voltable.views import Views

    return Views(spark, "/root/testdata/sf0.001")
