import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ragtide.session import local_session
    s = local_session("*", shuffle_partitions=8, app_name="ragtide-tests")
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    """A fresh scratch folder per test (never reused, never cleared)."""
    return tempfile.mkdtemp(prefix="ragtide-test-", dir="/tmp")


SF_SMALL = "/root/testdata/sf0.001"
SF_MED = "/root/testdata/sf0.01"
