"""Rows that every operator must bear, and a session that deals them over several tasks."""

import pytest


@pytest.fixture(scope="session")
def tables(spark):
    """Make a table from rows, dealt over three partitions."""
    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)
    return make
