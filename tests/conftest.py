import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from forgeframe.session import local_session

    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    s = local_session(4, 4, "3g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
