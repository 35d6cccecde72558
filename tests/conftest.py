import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="8", shuffle_partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Sorted tuples of chosen columns."""
    def get(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((x is not None, x) for x in r))
    return get


@pytest.fixture
def points(spark):
    """Points of one series from (t, v) pairs."""
    def make(pairs, kind="DOUBLE", series="s"):
        cast = float if kind == "DOUBLE" else (lambda x: x)
        return spark.createDataFrame([(series, t, cast(v)) for t, v in pairs], f"series STRING, t BIGINT, v {kind}")
    return make
