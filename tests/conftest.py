import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def no_literals_no_broadcast(monkeypatch):
    """Make every table too large for literals and broadcasts, to take the other way."""
    from placeweave.operators import skew

    monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(skew.small_values, "__kwdefaults__", {"rows": -1})
