"""Predicates of pairs, whose facts grow with the square of what they are made from."""

import glob
import itertools
import random

import pytest
from pyspark.sql import functions as F

from stratalog.engine import Engine

SG = "sg(X, Y) :- par(X, P), par(Y, P). sg(X, Y) :- par(X, A), sg(A, B), par(Y, B). "


def same_generation(par):
    sg = {(x, y) for x, p in par for y, q in par if p == q}
    while True:
        more = {(x, y) for x, a in par for y, b in par if (a, b) in sg} - sg
        if not more:
            return sorted(sg)
        sg |= more


@pytest.fixture
def written(spark, tmp_path, monkeypatch):
    """How many rows the rounds wrote under a name."""
    folders = itertools.count()
    monkeypatch.setattr("stratalog.engine.shared_folder", lambda spark: f"{tmp_path}/{next(folders)}")
    return lambda name: sum(spark.read.parquet(f).count() for f in glob.glob(f"{tmp_path}/*/{name}"))


def test_rounds_of_same_generation_are_of_classes(spark, written):
    par = [(f"s{i}", f"n{i % 6}") for i in range(60)] + [(f"n{i}", f"r{i % 2}") for i in range(6)] + [("s7", "n2"), ("odd", "n1"), ("odd", "r0")]
    e = Engine(spark)
    e.register("par", spark.createDataFrame(par + par[:9], "x string, y string"))
    e.execute(SG)
    wanted = same_generation(par)
    assert e.answers("sg(X, Y)") == wanted
    assert 0 < written("*sg-2-delta-*") < len(wanted) / 10
    assert "Aggregate" not in e.query("sg(X, Y)", sort=False)._jdf.queryExecution().optimizedPlan().toString()
    e.verify()
    assert e.answers("sg(odd, Y)") == [(y,) for x, y in wanted if x == "odd"]


@pytest.mark.parametrize("rules", [
    SG,
    "sg(X, Y) :- par(X, P), par(Y, P), P != b1. sg(X, Y) :- sg(A, B), par(Y, B), par(X, A), not odd(A).",
    "sg(X, Y) :- par(X, P), tie(Y, P, Q). sg(X, Y) :- par(X, A), sg(A, B), tie(Y, B, 1).",
    "sg(X, Y, Z) :- par(X, P), par(Y, P), par(Z, P). sg(X, Y, Z) :- par(X, A), sg(A, B, C), par(Y, B), par(Z, C).",
    "sg(X, Y) :- par(X, P), par(Y, Q), Q = P. sg(X, Y) :- par(X, A), sg(A, A), par(Y, A).",
])
def test_classes_of_mixed_values(spark, rules):
    rng = random.Random(3)
    facts = " ".join(f"par({rng.choice([i, i + 0.5, f'a{i}'])}, {rng.choice(['b1', 'b2', 7, 7.5])}). tie({i}, {rng.choice(['b1', 7])}, {rng.randrange(2)})." for i in range(24))
    e = Engine(spark)
    e.execute(facts + "par(b1, top). par(b2, top). par(7.0, top). par(7.5, 7). odd(7). " + rules)
    e.verify()
    e.execute("par(b1, b2). par(later, 7).")
    e.verify()


def parts_and_plan(e, goals):
    df = e.query(goals, sort=False)
    return df.select(F.spark_partition_id()).distinct().count(), df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_one_key_are_dealt_out_without_a_distinct_over_them(spark):
    e = Engine(spark)
    e.register("at", spark.range(3000).selectExpr("id AS x", "7 AS n", "id % 10 AS b").coalesce(1))
    e.execute("pair(X, Y) :- at(X, N, B), at(Y, N, C), X < Y.")
    parts, plan = parts_and_plan(e, "pair(X, Y)")
    assert parts > 4 and plan.startswith("Union")
    assert e.query("pair(X, Y)", sort=False).count() == 3000 * 2999 // 2


def test_pairs_near_each_other_are_dealt_out_without_a_distinct_over_them(spark):
    e = Engine(spark)
    e.register("at", spark.range(600).selectExpr("id AS x", "7 AS n", "cast(id as double) / 4 AS b").coalesce(1))
    e.execute("near(X, Y) :- at(X, N, B), at(Y, M, C), B < C, D = C - B, D < 10.")
    parts, plan = parts_and_plan(e, "near(X, Y)")
    assert parts > 4 and plan.startswith("Union")
    assert e.answers("near(X, Y)") == sorted((x, y) for x in range(600) for y in range(600) if x < y < x + 40)


@pytest.mark.parametrize("key", ["long", "double", "string"])
def test_pairs_whose_values_have_several_rows(spark, key):
    rng = random.Random(4)
    rows = [(x, rng.randrange(4), rng.randrange(-20, 20) / 2) for x in range(40) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
    rows += rows[:9]
    other = [(y, rng.randrange(4)) for y in range(30) for _ in range(rng.choice([1, 1, 2]))]
    e = Engine(spark)
    e.register("at", spark.createDataFrame(rows, "x long, n long, b double").selectExpr("x", f"cast(n as {key}) n", "b"))
    e.register("by", spark.createDataFrame(other, "y long, n long").selectExpr("y", f"cast(n as {'string' if key == 'string' else 'long'}) n"))
    e.execute("""
    pair(X, Y) :- at(X, N, B), at(Y, N, C), X < Y. near(X, Y) :- at(X, N, B), at(Y, M, C), B < C, D = C - B, D < 2.
    met(Y, X) :- at(X, N, B), by(Y, N), B > 0. own(X, Y) :- at(X, N, 0.5), by(Y, M), X != Y. same(X, Y) :- at(X, N, B), at(Y, N, B).
    """)
    made = {
        "pair(X, Y)": {(x, y) for x, n, _ in rows for y, m, _ in rows if n == m and x < y},
        "near(X, Y)": {(x, y) for x, _, b in rows for y, _, c in rows if b < c and c - b < 2},
        "met(Y, X)": {(y, x) for x, n, b in rows for y, m in other if n == m and b > 0},
        "own(X, Y)": {(x, y) for x, _, b in rows for y, _ in other if b == 0.5 and x != y},
        "same(X, Y)": {(x, y) for x, n, b in rows for y, m, c in rows if (n, b) == (m, c)},
    }
    for goals, wanted in made.items():
        assert e.answers(goals) == sorted(wanted), goals
        assert e.query(goals, sort=False).count() == len(wanted), goals
    e.execute("at(2, 3, 0.5). far(X) :- near(X, Y).")
    assert (2,) in e.answers("far(X)")
