import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from oracle import session

    return session()


@pytest.fixture(scope="session")
def column(spark):
    """Values of one expression over rows given as dictionaries."""

    def values(rows, expression, schema=None):
        df = spark.createDataFrame(rows, schema)
        return [r[0] for r in df.coalesce(1).select(expression.alias("x")).collect()]

    return values
