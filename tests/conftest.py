from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tidemark.session import session

    at = tmp_path_factory.mktemp("spark")
    s = session(
        "tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false",
        spark__local__dir=str(at / "local"), spark__sql__warehouse__dir=str(at / "warehouse"), spark__checkpoint__dir=str(at / "checkpoint"),
    )
    s.sparkContext.setCheckpointDir(str(at / "checkpoint"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
