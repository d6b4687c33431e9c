import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from quarrystone.session import local_session

    s = local_session(4, 4, "4g", **{"spark.ui.showConsoleProgress": "false"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    d = f"{DATA}/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    return d
