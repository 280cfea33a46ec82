import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from evidex.session import build_session

    shared = tmp_path_factory.mktemp("shared")
    return build_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{shared}", spark__driver__memory="3g")
