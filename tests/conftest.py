import contextlib
import io
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ledgerline.session import local_session

    s = local_session("*", shuffle_partitions=8, app="ledgerline-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck_sf001():
    from tools.check_oracle import duck

    return duck(SF001)


@pytest.fixture(scope="session")
def duck_sf01():
    from tools.check_oracle import duck

    return duck(SF01)


def plan_text(df) -> str:
    """The physical plan as printed by ``explain`` (public API)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()
