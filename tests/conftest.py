import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lodestar.session import local_session

    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate one SQL expression."""

    def run(expression: str, **columns):
        from pyspark.sql import Row

        names = list(columns)
        schema = ", ".join(f"{n} {t}" for n, (t, _) in columns.items()) or "z int"
        row = Row(*(names or ["z"]))(*([v for _, v in columns.values()] or [0]))
        return spark.createDataFrame([row], schema).selectExpr(f"{expression} AS out").first()["out"]

    return run


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    return SF
