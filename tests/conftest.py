import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millrace.session import local_session  # noqa: E402
from millrace.sources.tables import Warehouse  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "4", "tests", **{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4"}
    )
    yield session
    session.stop()


@pytest.fixture
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "warehouse"))


@pytest.fixture
def column():
    """The values of one column, in the order of another."""

    def values(df, name, order=None):
        rows = df.collect()
        if order is not None:
            rows = sorted(rows, key=lambda row: row[order])
        return [row[name] for row in rows]

    return values
