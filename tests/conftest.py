import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from plainledger.session import SPREAD_KEY, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    # Tests run the plans of a cluster, where no table is dealt out for its few splits.
    session.conf.unset(SPREAD_KEY)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression over one row of literals."""
    def value(column, **fields):
        row = spark.range(1)
        from pyspark.sql import functions as F

        for name, item in fields.items():
            row = row.withColumn(name, F.lit(item))
        return row.select(column.alias("x")).first()["x"]

    return value
