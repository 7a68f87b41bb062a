import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from vigil.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="vigil-tests")
    yield s
    s.stop()


SF0001 = os.environ.get("VIGIL_TEST_SF", "/root/testdata/sf0.001")
