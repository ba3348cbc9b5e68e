import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fretelens.session import local_session
    s = local_session("*", shuffle_partitions=8, app="fretelens-tests")
    yield s
    s.stop()


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached():
    """What the tests of a module cache goes with them."""
    yield
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    if s is not None and s.sparkContext._jsc is not None:
        s.catalog.clearCache()
