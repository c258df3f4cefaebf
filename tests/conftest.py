import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from memlake.session import build_session

    s = build_session("tests", "8")
    s.sparkContext.setLogLevel("ERROR")
    return s
