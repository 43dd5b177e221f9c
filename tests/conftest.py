import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from phraseloom.session import session

    own = session("local[4]", 4, spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__ui__enabled="false", spark__driver__memory="4g", spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    own.sparkContext.setLogLevel("ERROR")
    yield own
    own.stop()
