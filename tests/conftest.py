import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from corpusengine.session import get_session

    s = get_session("local[4]", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
