"""Every registered query on the smallest tables: against its SQL, or at least non-empty."""

import pytest

from foldline.plans import catalog
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = catalog.load()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    status, note = compare(spark, con, SF, QUERIES[name])
    assert status in ("ok", "rows"), f"{status}: {note}"


def test_most_queries_have_sql():
    assert sum(q.sql is not None for q in QUERIES.values()) > 0.85 * len(QUERIES)
