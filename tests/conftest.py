import os
import sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from moodgauge.session import build_session
    s = build_session("local[4]", app="moodgauge-tests", shuffle_partitions=8)
    yield s
    s.stop()
