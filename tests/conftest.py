import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]


@pytest.fixture(scope="session")
def spark():
    from tablewise.session import build_session

    session = build_session(
        "tablewise-tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="8g",
        spark__driver__extraJavaOptions="-XX:+UseParallelGC",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
