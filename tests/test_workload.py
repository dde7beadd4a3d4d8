"""Every registered query against its oracle SQL, on the smallest tables."""

import pytest

from compare import connection, difference
from conftest import SF_DIR
from tersa.workload.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def oracle():
    return connection(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert difference(df, oracle, ORACLES[name]) is None
    else:
        assert df.count() > 0
