import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from faultline.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "faultline-tests", **{"spark.driver.memory": "4g"})
