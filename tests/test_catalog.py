"""Every query of the catalog against its SQL at the smallest scale."""

import pytest
from oracle import rows_of

from stratalog.plans.catalog import ORACLES, QUERIES, flagship

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, name):
    mine, theirs, a, b = rows_of(spark, DIR, name, QUERIES[name], ORACLES[name])
    assert mine == theirs and a == b


def test_flagship(spark):
    assert flagship(spark, DIR).count() == 25
