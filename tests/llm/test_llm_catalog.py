import os

import pytest

from tessera.llm import catalog
from tests import compare

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.SMALL), reason="no test data")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return compare.connection()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, con, name):
    compare.same(spark, catalog.QUERIES[name], catalog.ORACLES[name], con)
