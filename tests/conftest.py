import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from respscore.session import local_session

    scratch = tempfile.mkdtemp(prefix="respscore-tests-", dir="/tmp")
    s = local_session("*", 8, app="respscore-tests",
                      checkpoint_dir=os.path.join(scratch, "checkpoints"))
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    return tempfile.mkdtemp(prefix="respscore-out-", dir="/tmp")


HISTORY_SCHEMA = ("id string, created_at timestamp, method string, url string, has_response boolean, "
                  "status_code int, content_type_header string, location string, body string")


def make_history(spark, rows):
    """rows: (id, status, content_type_header, body) in input (list) order;
    created_at decreases so that newest-first order is the list order."""
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    data = [(rid, base - dt.timedelta(seconds=i), "GET", f"http://h/{rid}", True, st, ct, None, body)
            for i, (rid, st, ct, body) in enumerate(rows)]
    return spark.createDataFrame(data, HISTORY_SCHEMA)
