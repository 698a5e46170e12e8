import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers start from this environment: let them import test-module encoders too.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, os.path.join(ROOT, "tests")] + ([os.environ["PYTHONPATH"]] if os.environ.get("PYTHONPATH") else [])
)


@pytest.fixture(scope="session")
def spark():
    from pagetrail.session import local_session

    s = local_session("*", shuffle_partitions=8, app="pagetrail-tests")
    yield s
    s.stop()
