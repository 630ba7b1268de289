import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from millwatch import schemas  # noqa: E402
from millwatch.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false",
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoint")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def feed_of(spark):
    """Feed rows from (machine_id, machine_name, status, type, 'YYYY-MM-DD HH:MM[:SS]')."""
    def build(*rows):
        return spark.createDataFrame(
            [(*row[:4], row[4] and datetime.fromisoformat(row[4])) for row in rows], schemas.FEED)
    return build


@pytest.fixture
def orders_of(spark):
    """Work orders from keyword rows; what a test does not name has a plain value."""
    def build(*rows):
        plain = dict(id="WO-1", machine_id="Valve_01_01", issue_description="text", priority="low",
                     reporter_name="R", assignee="Ann Lee", timestamp="2024-01-30 00:00", created_at=None, status="open")
        out = []
        for i, row in enumerate(rows):
            full = {**plain, "id": f"WO-{i}", **row}
            full["created_at"] = full["created_at"] or full["timestamp"]
            for c in ("timestamp", "created_at"):
                full[c] = datetime.fromisoformat(full[c])
            out.append(tuple(full[f] for f in schemas.WORK_ORDERS.fieldNames()))
        return spark.createDataFrame(out, schemas.WORK_ORDERS)
    return build
