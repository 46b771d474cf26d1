import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from claimscope.session import local_session

    s = local_session(cpus=4, shuffle_partitions=4, app="claimscope-tests")
    yield s
    s.stop()
