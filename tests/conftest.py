import os

import pytest

from pelagrid import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "pelagrid-tests", "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("PELAGRID_TEST_TABLES", "/root/testdata/sf0.001")
