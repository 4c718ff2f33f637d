import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from beatloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ["BEATLOOM_TEST_DIR"] = str(tmp_path_factory.mktemp("work"))
    return local_session(8, "beatloom-tests")
