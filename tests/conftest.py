import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from shelfmark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="tests", memory="6g")
    yield session


@pytest.fixture(scope="session")
def texts(spark):
    """The values of a column function over a list of texts."""
    def run(values, function):
        rows = spark.createDataFrame([(n, value) for n, value in enumerate(values)], "n int, x string")
        return [row[0] for row in rows.orderBy("n").select(function(F.col("x"))).collect()]
    return run
