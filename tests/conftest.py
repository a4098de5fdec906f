import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from arborlake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Make a files table with content from ``{path: bytes}``."""
    def make(contents: dict[str, bytes], mtime_us: int = 1_704_067_200_000_000):
        rows = []
        for path, content in contents.items():
            parent, _, name = path.rpartition("/")
            rows.append((path, parent, name, len(content), mtime_us, None, 33188, None, content))
        return spark.createDataFrame(
            rows,
            "path STRING, parent STRING, filename STRING, size BIGINT, mtime_us BIGINT, "
            "created_us BIGINT, mode BIGINT, stat_error STRING, content BINARY")
    return make
