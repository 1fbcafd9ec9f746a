import random

import pytest

from stratalog.engine import Engine
from stratalog.functions.values import DatalogError


def answers(spark, program, goals, order=()):
    e = Engine(spark)
    e.execute(program)
    return e.answers(goals, order)


CASES = [
    ("feeds(spring, brook). feeds(brook, river).", "feeds(spring, X)", [("brook",)]),
    ("at(zinc, 6). at([7], 5). at(0.5, 4). at(alum, 3). at([], 2). at(300, 1). at(-4, 0).", "at(X, N)", [("-4", 0), ("0.5", 4), ("300", 1), ("alum", 3), ("zinc", 6), ("[]", 2), ("[7]", 5)]),
    ("flow(p, q). flow(q, r). flow(r, p). down(X, Y) :- flow(X, Y). down(X, Z) :- flow(X, Y), down(Y, Z).", "down(q, X)", [("p",), ("q",), ("r",)]),
    ("big(70). big(80). old(80). young(X) :- big(X), not old(X). aged(X, Y) :- young(X), Y = X + 5.", "aged(X, Y)", [(70, 75)]),
    ("w(4). w(4.0). w(-3).", "w(X)", [(-3,), (4,)]),
    (
        "port(oslo). port(lagos). ship(oslo, elk). ship(oslo, auk). berth(P, S) :- port(P), setof(V, ship(P, V), S). many([], 0). many(H!T, N) :- many(T, M), N = M + 1. docked(P, N) :- berth(P, S), many(S, N). least(1.0).",
        "docked(P, N), least(L), N >= L",
        [("oslo", 2, 1)],
    ),
    ("route([k, l, m]). on(X, H!T) :- X = H. on(X, H!T) :- on(X, T).", "route(S), on(X, S)", [("[k, l, m]", "k"), ("[k, l, m]", "l"), ("[k, l, m]", "m")]),
    ("start(z). shelf(s1). shelf(s2). book(s2, dune). book(s2, emma). all(L) :- start(z), setof([H, B], (shelf(H), setof(X, book(H, X), B)), L).", "all(L)", [("[[s1, []], [s2, [dune, emma]]]",)]),
    ("u(reed). u(12). u(0.75). u([12]). u(cons(reed, 12)).", "u(X), X : number", [("0.75",), ("12",)]),
    ("cut(H, T) :- whole(H!T). whole([8, 6, 4]). whole([]).", "cut(H, T)", [(8, "[6, 4]")]),
]


@pytest.mark.parametrize("program,goals,wanted", CASES)
def test_programs(spark, program, goals, wanted):
    assert answers(spark, program, goals) == wanted


@pytest.mark.parametrize(
    "program,code",
    [
        ("q(X, Y) :- p(X).", "InvalidRule"),
        ("q(X) :- X = Y, p(Z).", "InvalidRule"),
        ("q(X) :- p(X), not r(X, Y).", "InvalidRule"),
        ("w(X) :- p(X), not w(X).", "NotStratified"),
        ("w(X) :- p(X), setof(Y, w(Y), S).", "NotStratified"),
        ("n(Y) :- n(X), Y = X + 1.", "NotAdmissible"),
        ("p(X).", "InvalidFact"),
        ("p(1", "InvalidSyntax"),
        ("p(12abc).", "InvalidSyntax"),
        ("schema a(N: atom, int). a(1, 2).", "SchemaViolation"),
        ("schema a(atom). schema a(int).", "SchemaConflict"),
        ("p(9223372036854775808).", "NumericOverflow"),
    ],
)
def test_rejections(spark, program, code):
    with pytest.raises(DatalogError) as error:
        Engine(spark).execute(program)
    assert error.value.code == code


def test_failed_statement_leaves_earlier_ones(spark):
    e = Engine(spark)
    with pytest.raises(DatalogError):
        e.execute("p(1). q(X) :- r(Y).")
    assert e.answers("p(X)") == [(1,)]


def test_query_errors_and_order(spark):
    e = Engine(spark)
    e.execute("score(ann, 2). score(bob, 9). score(cy, 2).")
    assert [r[0] for r in e.answers("score(P, S)", (("S", True),))] == ["bob", "ann", "cy"]
    for goals, order, code in (("score(P, S), P < 3", (), "NumericType"), ("score(P, S)", (("Z", False),), "UnknownVariable"), ("not score(P, S)", (), "InvalidQuery")):
        with pytest.raises(DatalogError) as error:
            e.answers(goals, order)
        assert error.value.code == code
    assert e.answers("score(ann, 2)") == [(True,)] and e.answers("score(ann, 3)") == []


def test_changes_and_contributors(spark):
    e = Engine(spark)
    e.execute("p(1). p(2). q(X) :- p(X).")
    assert e.execute("p(1)~").changed and e.answers("q(X)") == [(2,)]
    assert e.apply_changes({("p", 1): [(5,), (2,)]}, {("p", 1): [(2,)]}).changed and e.answers("q(X)") == [(2,), (5,)]
    assert not e.apply_changes({("p", 1): [(5,)]}, {}).changed
    e.set_contribution("one", [(("r", 1), (1,)), (("r", 1), (2,))])
    e.set_contribution("two", [(("r", 1), (2,))])
    e.set_contribution("one", [])
    assert e.answers("r(X)") == [(2,)]


def test_random_edges_against_plain_closure(spark):
    rng = random.Random(5)
    for _ in range(3):
        edges = {(rng.choice("abcde"), rng.choice("abcde")) for _ in range(6)}
        facts = " ".join(f"edge({x}, {y})." for x, y in edges)
        wanted = set(edges)
        while True:
            more = wanted | {(a, d) for a, b in wanted for c, d in wanted if b == c}
            if more == wanted:
                break
            wanted = more
        linear = answers(spark, facts + "path(X, Y) :- edge(X, Y). path(X, Z) :- edge(X, Y), path(Y, Z).", "path(X, Y)")
        free = answers(spark, facts + "path(X, Y) :- edge(X, Y). path(X, Z) :- path(X, Y), path(Y, Z).", "path(X, Y)")
        assert linear == free == sorted(wanted)
