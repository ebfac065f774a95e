import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark():
    from depotwise.session import local_session, release

    session = local_session(8, shuffle_partitions=2, memory="6g")
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def seed(spark):
    from fixture import seed_domain

    return seed_domain(spark)
