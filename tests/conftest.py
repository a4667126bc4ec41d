import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from repoaudit.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def files_of(spark):
    def make(files: dict[str, str], repo: str = "r"):
        rows = [(repo, path, content) for path, content in files.items()]
        return spark.createDataFrame(rows, "repo string, path string, content string")

    return make
