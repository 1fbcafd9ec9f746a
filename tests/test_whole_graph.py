"""Recursion over a graph of all suppliers, against brute force."""

import pytest

from stratalog.plans.catalog import QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def suppliers(spark):
    return dict(spark.read.parquet(f"{DIR}/supplier.parquet").select("s_suppkey", "s_nationkey").collect())


@pytest.fixture(scope="module")
def paths(suppliers):
    found = set()
    for x in suppliers:
        y = x
        while y + 1 in suppliers and suppliers[y] < suppliers[y + 1]:
            y += 1
            found.add((x, y))
    return found


def rows(spark, name):
    return sorted(map(tuple, QUERIES[name](spark, DIR).collect()))


@pytest.mark.parametrize("name", ["tc_linear_right", "tc_linear_left", "tc_nonlinear"])
def test_paths(spark, paths, name):
    assert max(x for x, _ in paths) >= 24 and rows(spark, name) == sorted(paths)


def test_over_paths(spark, suppliers, paths):
    assert rows(spark, "mutual_even_odd") == sorted((x, y) for x, y in paths if (y - x) % 2 == 0)
    assert rows(spark, "negation_over_recursion") == sorted((x,) for x in suppliers if x not in {y for _, y in paths})
    assert rows(spark, "agg_over_recursion") == sorted((x, sum(a == x for a, _ in paths)) for x in suppliers)
