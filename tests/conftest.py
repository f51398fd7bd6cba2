import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# Python workers unpickle classes of the package and of the tests by name.
os.environ["PYTHONPATH"] = os.pathsep.join(
    [str(ROOT), str(ROOT / "tests"), os.environ.get("PYTHONPATH", "")])

TABLES = os.environ.get("STREAMLAT_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from streamlat.session import build_session

    session = build_session(
        "tests", master="local[8]", parallelism=8,
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "4g",
           "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def lines(spark):
    """Lines from strings."""
    def make(*texts):
        return spark.createDataFrame([(text,) for text in texts], "line string")
    return make


@pytest.fixture
def typed(spark):
    """Records from (seq, created_ms) pairs."""
    def make(*pairs):
        return spark.createDataFrame(list(pairs), "seq bigint, created_ms bigint")
    return make
