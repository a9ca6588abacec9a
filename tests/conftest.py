import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")

from tessera.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", memory="6g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
