import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tessera.session import local_session, ship_package, use_shared_folder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    ship_package(s)
    use_shared_folder(s)
    yield s
    s.stop()
