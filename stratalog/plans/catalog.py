"""The queries by name: each a program over the host tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.engine import Engine
from stratalog.functions.values import Atom
from stratalog.operators.body import Relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def engine(spark: SparkSession, sf_dir: str, **tables: str) -> Engine:
    """An engine with predicates named by keyword, each ``table: columns`` of the folder; other columns aren't read."""
    e = Engine(spark)
    for name, said in tables.items():
        table, _, columns = said.partition(":")
        e.register(name, spark.read.parquet(f"{sf_dir}/{table.strip()}.parquet"), columns.split())
    return e


def query(name: str, program: str, goals: str, columns: str, sql: str, order: tuple = (), then: Callable[[Engine], None] | None = None, **tables: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, **tables)
        e.execute(program)
        if then:
            then(e)
        return e.query(goals, order, sort=bool(order)).toDF(*columns.split())

    QUERIES[name], ORACLES[name] = run, sql


NATION, REGION = "nation: n_nationkey n_name n_regionkey", "region: r_regionkey r_name"
SUPPLIER, CUSTOMER = "supplier: s_suppkey s_nationkey s_acctbal", "customer: c_custkey c_nationkey c_acctbal"
ORDERS = "orders: o_orderkey o_custkey o_orderstatus o_totalprice o_orderpriority"
LENGTH = "length([], 0). length(H!T, N) :- length(T, M), N = M + 1. "
SUM = "sum([], 0). sum(H!T, N) :- sum(T, M), N = M + H. "

query("select_constants", "", "nation(K, N, 0)", "k n", "SELECT n_nationkey::bigint AS k, n_name AS n FROM nation WHERE n_regionkey = 0", nation=NATION)
query("repeated_variable", "", "nation(X, N, X)", "x n", "SELECT n_nationkey::bigint AS x, n_name AS n FROM nation WHERE n_nationkey = n_regionkey", nation=NATION)
query("join_chain", "spread(R, S) :- region(K, R), nation(N, M, K), customer(C, N, B), orders(O, C, S, P, U).", "spread(R, S)", "region status",
      "SELECT DISTINCT r_name AS region, o_orderstatus AS status FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey", region=REGION, nation=NATION, customer=CUSTOMER, orders=ORDERS)
query("self_join", "pair(X, Y) :- supplier(X, N, B), supplier(Y, N, C), X < Y.", "pair(X, Y)", "x y", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b USING (s_nationkey) WHERE a.s_suppkey < b.s_suppkey", supplier=SUPPLIER)
query("compare_ops", "", "orders(O, C, S, P, U), P >= 1000, P < 50000, not P <= 2000", "o c s p u", "SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus AS s, o_totalprice AS p, o_orderpriority AS u FROM orders WHERE o_totalprice > 2000 AND o_totalprice < 50000", orders=ORDERS)
query("inequality", "open(O) :- orders(O, C, S, P, U), S <> 'F', U != '5-LOW'.", "open(O)", "o", "SELECT DISTINCT o_orderkey AS o FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'", orders=ORDERS)
query("negated_builtin", "low(C) :- customer(C, N, B), not B > 1000.", "low(C)", "c", "SELECT DISTINCT c_custkey AS c FROM customer WHERE NOT c_acctbal > 1000", customer=CUSTOMER)
query("anti_join", "urgent(C) :- orders(O, C, S, P, '1-URGENT'). quiet(C) :- customer(C, N, B), not urgent(C).", "quiet(C)", "c", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')", customer=CUSTOMER, orders=ORDERS)
query("ground_negation", "none(K) :- region(K, R), not nation(99, nowhere, 0).", "none(K)", "k", "SELECT r_regionkey::bigint AS k FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 99)", region=REGION, nation=NATION)
query("semi_join", "used(N) :- nation(N, M, R), supplier(S, N, B).", "used(N)", "n", "SELECT DISTINCT n_nationkey::bigint AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey", nation=NATION, supplier=SUPPLIER)
_SIDES = "rich(N) :- customer(C, N, B), B > 9800. has(N) :- supplier(S, N, B), B > 4000. "
_RICH, _HAS = "SELECT DISTINCT c_nationkey::bigint AS n FROM customer WHERE c_acctbal > 9800", "SELECT DISTINCT s_nationkey::bigint AS n FROM supplier WHERE s_acctbal > 4000"
query("set_union", _SIDES + "r(N) :- rich(N). r(N) :- has(N).", "r(N)", "n", f"{_RICH} UNION {_HAS}", customer=CUSTOMER, supplier=SUPPLIER)
query("set_intersect", _SIDES + "r(N) :- rich(N), has(N).", "r(N)", "n", f"{_RICH} INTERSECT {_HAS}", customer=CUSTOMER, supplier=SUPPLIER)
query("set_difference", _SIDES + "r(N) :- has(N), not rich(N).", "r(N)", "n", f"{_HAS} EXCEPT {_RICH}", customer=CUSTOMER, supplier=SUPPLIER)
query("cross_product", "", "region(K, N), region(L, M)", "k n l m", "SELECT a.r_regionkey::bigint AS k, a.r_name AS n, b.r_regionkey::bigint AS l, b.r_name AS m FROM region a CROSS JOIN region b", region=REGION)
query("range_join", "near(X, Y) :- supplier(X, N, B), supplier(Y, M, C), B < C, D = C - B, D < 50.", "near(X, Y)", "x y", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal AND b.s_acctbal - a.s_acctbal < 50", supplier=SUPPLIER)
query("arith_add_sub", "t(K, A, B) :- nation(K, N, R), A = K + 10, B = R - K.", "t(K, A, B)", "k a b", "SELECT n_nationkey::bigint AS k, n_nationkey::bigint + 10 AS a, n_regionkey::bigint - n_nationkey AS b FROM nation", nation=NATION)
query("arith_mixed", "t(S, D) :- supplier(S, N, B), D = B - N.", "t(S, D)", "s d", "SELECT s_suppkey AS s, s_acctbal - s_nationkey::double AS d FROM supplier", supplier=SUPPLIER)
query("arith_bound", "t(K) :- nation(K, N, R), 5 = K + R.", "t(K)", "k", "SELECT n_nationkey::bigint AS k FROM nation WHERE n_nationkey + n_regionkey = 5", nation=NATION)
query("type_test", "v(oak). v(7). v(0.25). v([]). v([3, 4]). v([3, elm]). v(cons(oak, 7)). v(K) :- nation(K, N, R). v(N) :- nation(K, N, R). t(X, atom) :- v(X), X : atom. t(X, int) :- v(X), X : int. t(X, number) :- v(X), X : number. t(X, list) :- v(X), X : list. t(X, ints) :- v(X), X : list(int). t(X, any) :- v(X), X : any. t(X, none) :- v(X), not X : number, not X : list, not X : atom.", "t(X, K)", "x k",
      """WITH v(x, k) AS (SELECT * FROM (VALUES ('oak','atom'),('7','int'),('0.25','float'),('[]','ints'),('[3, 4]','ints'),('[3, elm]','list'),('cons(oak, 7)','none')) UNION SELECT n_nationkey::varchar, 'int' FROM nation UNION SELECT CASE WHEN regexp_full_match(n_name, '[a-z_][A-Za-z0-9_]*') THEN n_name ELSE chr(39) || n_name || chr(39) END, 'atom' FROM nation)
      SELECT x, k FROM v WHERE k <> 'float' UNION SELECT x, 'number' FROM v WHERE k IN ('int', 'float') UNION SELECT x, 'list' FROM v WHERE k = 'ints' UNION SELECT x, 'any' FROM v""", nation=NATION)
_POOR = "poor(N, S) :- supplier(S, N, B), B < 0. "
_RENDER = "'[' || coalesce(array_to_string(list_sort(list_distinct(list({0}) FILTER ({0} IS NOT NULL))), ', '), '') || ']'"
query("setof_groups", _POOR + "g(N, L) :- nation(N, M, R), setof(S, poor(N, S), L).", "g(N, L)", "n l", f"SELECT n_nationkey::bigint AS n, {_RENDER.format('s_suppkey')} AS l FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0 GROUP BY 1", nation=NATION, supplier=SUPPLIER)
query("setof_empty_test", _POOR + "g(N) :- nation(N, M, R), setof(S, poor(N, S), []).", "g(N)", "n", "SELECT n_nationkey::bigint AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 0)", nation=NATION, supplier=SUPPLIER)
query("setof_global", _POOR + "g(L) :- setof(N, poor(N, S), L).", "g(L)", "l", f"SELECT {_RENDER.format('s_nationkey')} AS l FROM supplier WHERE s_acctbal < 0", supplier=SUPPLIER)
query("setof_nested", "g(R, L) :- region(R, M), setof([N, S], (nation(N, A, R), setof(K, supplier(K, N, B), S)), L).", "g(R, L)", "r l",
      f"WITH inner_sets AS (SELECT n_regionkey, n_nationkey, {_RENDER.format('s_suppkey')} AS s FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2) SELECT r_regionkey::bigint AS r, '[' || coalesce(string_agg('[' || n_nationkey || ', ' || s || ']', ', ' ORDER BY n_nationkey), '') || ']' AS l FROM region LEFT JOIN inner_sets ON n_regionkey = r_regionkey GROUP BY 1", region=REGION, nation=NATION, supplier=SUPPLIER)
query("setof_bag", "collectfirst([], []). collectfirst([H, K]!T, H!R) :- collectfirst(T, R). g(R, L) :- region(R, M), setof([N, S], supplied(R, N, S), P), collectfirst(P, L). supplied(R, N, S) :- nation(N, A, R), supplier(S, N, B).", "g(R, L)", "r l",
      "SELECT r_regionkey::bigint AS r, '[' || coalesce(array_to_string(list_sort(list(n_nationkey) FILTER (s_suppkey IS NOT NULL)), ', '), '') || ']' AS l FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1", region=REGION, nation=NATION, supplier=SUPPLIER)
query("count_via_length", LENGTH + "n(C, N) :- customer(C, K, B), setof(O, orders(O, C, S, P, U), L), length(L, N).", "n(C, N)", "c n", "SELECT c_custkey AS c, count(DISTINCT o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1", customer=CUSTOMER, orders=ORDERS)
query("sum_via_fold", SUM + "n(N, T) :- nation(N, M, R), setof(S, supplier(S, N, B), L), sum(L, T).", "n(N, T)", "n t", "SELECT n_nationkey::bigint AS n, coalesce(sum(s_suppkey), 0)::bigint AS t FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1", nation=NATION, supplier=SUPPLIER)
query("min_via_head", "n(N, X) :- nation(N, M, R), setof(B, supplier(S, N, B), X!T).", "n(N, X)", "n x", "SELECT s_nationkey::bigint AS n, min(s_acctbal) AS x FROM supplier GROUP BY 1", nation=NATION, supplier=SUPPLIER)
query("list_member", "member(X, H!T) :- X = H. member(X, H!T) :- member(X, T). g(R, L) :- region(R, M), setof(N, nation(N, A, R), L). m(R, X) :- g(R, L), member(X, L).", "m(R, X)", "r x", "SELECT n_regionkey::bigint AS r, n_nationkey::bigint AS x FROM nation", region=REGION, nation=NATION)
query("list_destructure", LENGTH + "s(R, L) :- region(R, M), setof(K, nation(K, A, R), L). g(R, H, N) :- s(R, L), L = H!T, length(T, N).", "g(R, H, N)", "r h n", "SELECT n_regionkey::bigint AS r, min(n_nationkey)::bigint AS h, count(*) - 1 AS n FROM nation GROUP BY 1", region=REGION, nation=NATION)
query("list_construct", "g(N, L) :- nation(N, M, R), L = [R, N].", "g(N, L)", "n l", "SELECT n_nationkey::bigint AS n, '[' || n_regionkey || ', ' || n_nationkey || ']' AS l FROM nation", nation=NATION)
_CYCLE = "hop(A, B) :- nation(A, N, R), nation(B, M, R), B = A + 1. hop(A, B) :- nation(A, N, R), nation(B, M, S), A = B + 5. "
query("tc_cyclic", _CYCLE + "path(X, Y) :- hop(X, Y). path(X, Z) :- hop(X, Y), path(Y, Z).", "path(X, Y)", "x y",
      "WITH RECURSIVE hop AS (SELECT a.n_nationkey::bigint AS x, b.n_nationkey::bigint AS y FROM nation a JOIN nation b ON (b.n_nationkey = a.n_nationkey + 1 AND a.n_regionkey = b.n_regionkey) OR a.n_nationkey = b.n_nationkey + 5), path AS (SELECT x, y FROM hop UNION SELECT h.x, p.y FROM hop h JOIN path p ON h.y = p.x) SELECT x, y FROM path", nation=NATION)
query("same_generation", "par(X, Y) :- place(X, N), nation(N, Y, R). par(X, Y) :- nation(N, X, R), region(R, Y). sg(X, Y) :- par(X, P), par(Y, P). sg(X, Y) :- par(X, A), sg(A, B), par(Y, B).", "sg(X, Y)", "x y",
      "WITH RECURSIVE par AS (SELECT s_name AS x, n_name AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), sg AS (SELECT a.x, b.x AS y FROM par a JOIN par b ON a.y = b.y UNION SELECT a.x, b.x FROM par a JOIN sg s ON a.y = s.x JOIN par b ON b.y = s.y) SELECT x, y FROM sg", place="supplier: s_name s_nationkey", nation=NATION, region=REGION)
# A graph of all suppliers: ascending runs of nation keys among neighbours by supplier key.
RUNS = "link(X, Y) :- supplier(X, N, B), supplier(Y, M, C), Y = X + 1, N < M. "
RUNS_SQL = "WITH RECURSIVE link AS (SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1 WHERE a.s_nationkey < b.s_nationkey), path AS (SELECT x, y FROM link UNION SELECT l.x, p.y FROM link l JOIN path p ON l.y = p.x)"
_RIGHT = "path(X, Y) :- link(X, Y). path(X, Z) :- link(X, Y), path(Y, Z). "
query("tc_linear_right", RUNS + _RIGHT, "path(X, Y)", "x y", f"{RUNS_SQL} SELECT x, y FROM path", supplier=SUPPLIER)
query("tc_linear_left", RUNS + "path(X, Y) :- link(X, Y). path(X, Z) :- path(X, Y), link(Y, Z).", "path(X, Y)", "x y", f"{RUNS_SQL} SELECT x, y FROM path", supplier=SUPPLIER)
query("tc_nonlinear", RUNS + "path(X, Y) :- link(X, Y). path(X, Z) :- path(X, Y), path(Y, Z).", "path(X, Y)", "x y", f"{RUNS_SQL} SELECT x, y FROM path", supplier=SUPPLIER)
query("mutual_even_odd", RUNS + "odd(X, Y) :- link(X, Y). odd(X, Z) :- link(X, Y), even(Y, Z). even(X, Z) :- link(X, Y), odd(Y, Z).", "even(X, Y)", "x y",
      f"{RUNS_SQL} SELECT x, y FROM path WHERE (y - x) % 2 = 0", supplier=SUPPLIER)
query("negation_over_recursion", RUNS + _RIGHT + "inner(Y) :- path(X, Y). first(X) :- supplier(X, N, B), not inner(X).", "first(X)", "x", f"{RUNS_SQL} SELECT s_suppkey AS x FROM supplier WHERE s_suppkey NOT IN (SELECT y FROM path)", supplier=SUPPLIER)
query("agg_over_recursion", RUNS + LENGTH + _RIGHT + "reach(X, N) :- supplier(X, K, B), setof(Y, path(X, Y), L), length(L, N).", "reach(X, N)", "x n", f"{RUNS_SQL} SELECT s_suppkey AS x, count(DISTINCT y) AS n FROM supplier LEFT JOIN path ON x = s_suppkey GROUP BY 1", supplier=SUPPLIER)
# Graphs that grow with the scale.
_STEPS = "step(X, Y) :- customer(X, N, B), customer(Y, M, C), Y = X + 1, N < M. "
_STEPS_SQL = "WITH RECURSIVE step AS (SELECT a.c_custkey AS x, b.c_custkey AS y FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_nationkey < b.c_nationkey), climb AS (SELECT x, y FROM step UNION SELECT l.x, p.y FROM step l JOIN climb p ON l.y = p.x)"
_CLIMB = "climb(X, Y) :- step(X, Y). climb(X, Z) :- climb(X, Y), climb(Y, Z). "
query("tc_customers", _STEPS + _CLIMB, "climb(X, Y)", "x y", f"{_STEPS_SQL} SELECT x, y FROM climb", customer=CUSTOMER)
query("reach_of_customers", _STEPS + _CLIMB + LENGTH + "far(X, N) :- customer(X, K, B), setof(Y, climb(X, Y), L), length(L, N).", "far(X, N)", "x n", f"{_STEPS_SQL} SELECT c_custkey AS x, count(DISTINCT y) AS n FROM customer LEFT JOIN climb ON x = c_custkey GROUP BY 1", customer=CUSTOMER)
# Exact numbers: integers beyond 2^53 beside other numbers in one column.
_MIXED = "m(S, V) :- supplier(S, N, B), V = S + 9007199254740992. m(S, B) :- supplier(S, N, B). "
query("exact_compare", _MIXED + "big(S) :- m(S, V), V > 9007199254740994.0.", "big(S)", "s", "SELECT s_suppkey AS s FROM supplier WHERE s_suppkey > 2", supplier=SUPPLIER)
query("exact_join", _MIXED + "k(V, S) :- supplier(S, N, B), V = S + 9007199254740993. same(S, T) :- m(S, V), k(V, T).", "same(S, T)", "s t", "SELECT a.s_suppkey AS s, b.s_suppkey AS t FROM supplier a JOIN supplier b ON a.s_suppkey = b.s_suppkey + 1", supplier=SUPPLIER)
query("exact_distinct", _MIXED + LENGTH + "n(K, N) :- region(K, R), setof(V, m(S, V), L), length(L, N).", "n(K, N)", "k n", "SELECT r_regionkey::bigint AS k, (SELECT count(DISTINCT s_suppkey) + count(DISTINCT s_acctbal) FROM supplier) AS n FROM region", supplier=SUPPLIER, region=REGION)
query("exact_difference", _MIXED + "d(S, D) :- m(S, V), V : int, V >= 9007199254740992, D = V - 9007199254740992, D : int.", "d(S, D)", "s d", "SELECT s_suppkey AS s, s_suppkey::varchar AS d FROM supplier", supplier=SUPPLIER)
# Structural recursion over the lists there are.
_ITEMS = "item(R, L) :- region(R, M), setof(N, nation(N, A, R), L). "
_ITEMS_SQL = "WITH items AS (SELECT r_regionkey::bigint AS r, coalesce(list_sort(list(n_nationkey::bigint) FILTER (n_nationkey IS NOT NULL)), []) AS l FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1), suffixes AS (SELECT r, i, l[i:] AS l FROM (SELECT r, l, unnest(generate_series(1, len(l))) AS i FROM items))"
query("list_append", _ITEMS + "more([98, 99]). append([], T, T) :- more(T). append(H!A, T, H!B) :- append(A, T, B). g(R, B) :- item(R, L), append(L, T, B).", "g(R, B)", "r b", f"{_ITEMS_SQL} SELECT r, '[' || array_to_string(list_concat(l, [98, 99]), ', ') || ']' AS b FROM items", region=REGION, nation=NATION)
query("list_last", _ITEMS + "last(X, H!T) :- X = H, T = []. last(X, H!T) :- last(X, T). g(R, X) :- item(R, L), last(X, L).", "g(R, X)", "r x", "SELECT n_regionkey::bigint AS r, max(n_nationkey)::bigint AS x FROM nation GROUP BY 1", region=REGION, nation=NATION)
query("list_prefix", _ITEMS + "run([], 0). run(H!T, N) :- run(T, M), supplier(S, H, B), N = M + 1. g(R, N) :- item(R, L), run(L, N).", "g(R, N)", "r n", f"{_ITEMS_SQL} SELECT r, len(l)::bigint AS n FROM items WHERE r NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier))", region=REGION, nation=NATION, supplier=SUPPLIER)
query("open_length", _ITEMS + LENGTH, "length(L, N)", "l n", f"{_ITEMS_SQL} SELECT DISTINCT '[' || array_to_string(l, ', ') || ']' AS l, len(l)::bigint AS n FROM suffixes UNION SELECT '[]', 0", region=REGION, nation=NATION)


def _then_changed(e: Engine) -> None:
    """Deletes after the closure is there, so that it is maintained rather than computed from nothing."""
    e.policy.mode = "incremental"
    e.materialize()
    e.retract("supplier(S, 7, B)")
    e.apply_changes({("supplier", 3): [(900001, 1, 0.5), (900002, 2, 0.5)]}, {})


_LESS_SQL = RUNS_SQL.replace("FROM supplier a JOIN supplier b", "FROM now a JOIN now b").replace("WITH RECURSIVE link", "WITH RECURSIVE now AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey <> 7 UNION SELECT 900001, 1 UNION SELECT 900002, 2), link")
query("apply_recursive_delete", RUNS + _RIGHT, "path(X, Y)", "x y", f"{_LESS_SQL} SELECT x, y FROM path", then=_then_changed, supplier=SUPPLIER)
query("apply_recursive_nonlinear", RUNS + "path(X, Y) :- link(X, Y). path(X, Z) :- path(X, Y), path(Y, Z).", "path(X, Y)", "x y", f"{_LESS_SQL} SELECT x, y FROM path", then=_then_changed, supplier=SUPPLIER)
query("order_by_desc", "", "supplier(S, N, B), B > 5000", "s n b", "SELECT s_suppkey AS s, s_nationkey::bigint AS n, s_acctbal AS b FROM supplier WHERE s_acctbal > 5000", order=(("B", True), ("S", False)), supplier=SUPPLIER)
_OUT = "r(N, M) :- nation(N, M, R), region(R, 'ASIA'). "
query("apply_insert", _OUT, "r(N, M)", "n m", "SELECT n_nationkey::bigint AS n, n_name AS m FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION SELECT 900, 'new' UNION SELECT 901, 'newer'",
      then=lambda e: e.apply_changes({("nation", 3): [(900, Atom("new"), 2), (901, Atom("newer"), 2)]}, {}), nation=NATION, region=REGION)
query("apply_delete", "r(N, M) :- nation(N, M, R).", "r(N, M)", "n m", "SELECT n_nationkey::bigint AS n, n_name AS m FROM nation WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
      then=lambda e: e.retract("nation(N, M, 1)"), nation=NATION)
query("apply_mixed", "r(N, M) :- nation(N, M, R).", "r(N, M)", "n m", "SELECT n_nationkey::bigint AS n, n_name AS m FROM nation WHERE n_regionkey <> 3 UNION SELECT 900, 'new'",
      then=lambda e: (e.retract("nation(N, M, 3)"), e.apply_changes({("nation", 3): [(900, Atom("new"), 3)]}, {("nation", 3): [(900, Atom("new"), 3)]})), nation=NATION)
query("retract_pattern", "p(a, 1). p(a, 2). p(b, 1). q(X, Y) :- p(X, Y). p(a, X)~", "q(X, Y)", "x y", "SELECT 'b' AS x, 1::bigint AS y")
query("contributor_union", "q(X) :- p(X).", "q(X)", "x", "SELECT * FROM (VALUES (1::bigint), (2), (4)) t(x)",
      then=lambda e: (e.set_contribution("one", [(("p", 1), (1,)), (("p", 1), (2,)), (("p", 1), (3,))]), e.set_contribution("two", [(("p", 1), (2,)), (("p", 1), (4,))]), e.set_contribution("one", [(("p", 1), (1,))])))
query("projected_view", _POOR + "v(R, L) :- nation(N, M, R), setof(S, poor(N, S), L).", "v(R, L)", "r l", f"SELECT DISTINCT r, l FROM (SELECT n_regionkey::bigint AS r, n_nationkey, {_RENDER.format('s_suppkey')} AS l FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal < 0 GROUP BY 1, 2)", nation=NATION, supplier=SUPPLIER)


query("projected_view_delete", _POOR + "v(R, L) :- nation(N, M, R), setof(S, poor(N, S), L).", "v(R, L)", "r l", f"SELECT DISTINCT r, l FROM (SELECT n_regionkey::bigint AS r, n_nationkey, {_RENDER.format('s_suppkey')} AS l FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 1 OR s_acctbal >= 0) AS kept ON s_nationkey = n_nationkey AND s_acctbal < 0 GROUP BY 1, 2)",
      then=lambda e: (e.materialize(), e.apply_changes({}, {("supplier", 3): Relation(e.relation(("supplier", 3)).df.where("c0 % 2 = 0 AND c2 < 0"), ("int", "int", "number"))})), nation=NATION, supplier=SUPPLIER)


def folded(name: str, program: str, views: list[str], base: list[tuple[str, int]], rules: list[str], goals: str, columns: str, sql: str, **tables: str) -> None:
    """A question answered from views and the named base relations alone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from stratalog.plans.folding import Views

        e = engine(spark, sf_dir, **tables)
        e.execute(program)
        catalog = Views(e)
        for v in views:
            catalog.define_view(v)
        for b in base:
            catalog.declare_base_available(*b)
        return catalog.answer_folded(catalog.fold_query(goals, rules), sort=False).toDF(*columns.split())

    QUERIES[name], ORACLES[name] = run, sql


_PATHS = ["path(X, Y) :- link(X, Y).", "path(X, Z) :- link(X, Y), path(Y, Z)."]
folded("fold_identity", RUNS, ["copy(Y, X) :- link(X, Y)."], [], _PATHS, "path(X, Y)", "x y", f"{RUNS_SQL} SELECT x, y FROM path", supplier=SUPPLIER)
folded("fold_even_paths", RUNS, ["two(X, Z) :- link(X, Y), link(Y, Z)."], [], _PATHS, "path(X, Y)", "x y", f"{RUNS_SQL} SELECT x, y FROM path WHERE (y - x) % 2 = 0", supplier=SUPPLIER)
folded("fold_canonical", "", ["by(R, S) :- nation(K, N, R), setof([A, B], nation(A, B, R), S)."], [], ["bigger(R, K) :- nation(K, N, R), nation(L, M, R), L > K.", "top(K) :- nation(K, N, R), not bigger(R, K)."], "top(K)", "k",
       "SELECT max(n_nationkey)::varchar AS k FROM nation GROUP BY n_regionkey", nation=NATION)
folded("fold_hybrid", "", ["copy(N, K, R) :- nation(K, N, R)."], [("supplier", 3)], ["served(M) :- supplier(S, K, B), nation(K, M, R), B > 0."], "served(M)", "m",
       "SELECT DISTINCT n_name AS m FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0", nation=NATION, supplier=SUPPLIER)


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, nation=NATION).rows("nation", 3, offset=5, limit=7, by=[(1, True)]).toDF("k", "n", "r", "origin")


QUERIES["paged_rows"] = _paged
ORACLES["paged_rows"] = "SELECT n_nationkey::bigint AS k, n_name AS n, n_regionkey::bigint AS r, 'base' AS origin FROM nation ORDER BY n_name DESC, n_nationkey LIMIT 7 OFFSET 5"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability over a graph of nations, the reachable set of each, its size, largest first."""
    e = engine(spark, sf_dir, nation=NATION)
    e.execute(_CYCLE + LENGTH + "path(X, Y) :- hop(X, Y). path(X, Z) :- hop(X, Y), path(Y, Z). reach(N, L, K) :- nation(N, M, R), setof(Y, path(N, Y), L), length(L, K).")
    return e.query("reach(N, L, K)", (("K", True),)).withColumnsRenamed({"N": "nation", "L": "reachable", "K": "n"})
