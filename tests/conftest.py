import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from meterframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = str(tmp_path_factory.mktemp("warehouse"))
    s = local_session("*", shuffle_partitions=8, app="meterframe-tests",
                      extra={"spark.sql.warehouse.dir": warehouse})
    yield s
    s.stop()


def T(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


def readings(spark, rows):
    """rows: (client_id, 'YYYY-MM-DD HH:MM[:SS]', y)"""
    return spark.createDataFrame([(c, T(t), None if y is None else float(y)) for c, t, y in rows],
                                 "client_id string, ts timestamp_ntz, y float")
