"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest

from lorekeep.plans import catalog
from tests.oracle import TESTDATA, compare, connect

FOLDER = f"{TESTDATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables are not there")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    if name in catalog.ORACLES:
        cursor = duck.execute(catalog.ORACLES[name])
        assert compare((df.columns, rows), ([d[0] for d in cursor.description], cursor.fetchall())) is None
    else:
        assert rows
