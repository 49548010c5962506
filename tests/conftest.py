import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Tiny inputs: compiling generated code would take most of the time.
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4", spark__sql__codegen__wholeStage="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
