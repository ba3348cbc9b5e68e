"""A session of their own for these tests, so that a failure here or there stays where it is."""

import pytest

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="package")
def spark():
    from fretelens.session import local_session
    s = local_session("*", shuffle_partitions=8, app="fretelens-llm-tests")
    yield s
    s.stop()
