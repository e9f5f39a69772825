import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyspark.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[4]", 4, spark__driver__memory="4g", spark__checkpoint__dir=str(tmp_path_factory.mktemp("ckpt")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
