import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from codesieve.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, app="tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Build a files table from (batch_id, path, code) or code texts."""

    def make(*rows, extra=None):
        data = []
        for i, r in enumerate(rows):
            batch, path, code = r if isinstance(r, tuple) else ("b", f"f{i}.py", r)
            data.append((batch, i, path, code))
        return spark.createDataFrame(data, "batch_id string, file_ord bigint, path string, code string")

    return make
