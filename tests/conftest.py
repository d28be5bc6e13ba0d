import pytest

from cellweave.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.cellweave.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
