from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from sheafwork.session import build_session

    home = tmp_path_factory.mktemp("warehouse")
    session = build_session(
        "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir=str(home),
        spark__sql__catalogImplementation="in-memory")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
