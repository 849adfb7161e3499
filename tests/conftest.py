import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from speechlake.session import local_session

    s = local_session(4, shuffle_partitions=4, memory="4g")
    yield s
    s.stop()
