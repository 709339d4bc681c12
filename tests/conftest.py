import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from traceframe.session import build_session
    s = build_session(master=f"local[{min(8, os.cpu_count() or 4)}]", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def checked(spark):
    """Every registered query on the smallest tables: (results, executed plans)."""
    from oracle_check import check
    plans = {}
    return check(spark, "/root/testdata/sf0.001", verbose=bool(os.environ.get("VERBOSE")), plans=plans), plans
