import os
import sys

import pytest
from hypothesis import settings

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

settings.register_profile("lectern", deadline=None)
settings.load_profile("lectern")

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lectern.session import local_session, ship

    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
