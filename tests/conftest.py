import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from terrane.session import Workspace, local_session  # noqa: E402
from terrane.sources.derived import DerivedTables  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=8, app="terrane-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def derived(spark):
    return DerivedTables(spark, SF_DIR)


@pytest.fixture()
def ws(spark):
    return Workspace(spark, "test")
