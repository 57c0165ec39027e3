import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_session

    return get_session("tests", "8")


@pytest.fixture(scope="session")
def duck():
    from harness import DATA, connect

    return connect(DATA)
