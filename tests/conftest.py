import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from custlens.session import build_session
    s = build_session(master="local[*]", shuffle_partitions=8, app="custlens-tests")
    import __spark_entry__  # noqa: F401  (registers every query)
    yield s


def rows(df, order=None):
    out = [r.asDict(recursive=True) for r in df.collect()]
    if order:
        out.sort(key=lambda r: tuple(r[c] for c in order))
    return out
