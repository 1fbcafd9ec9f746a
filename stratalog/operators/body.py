"""Rule bodies as DataFrame plans: joins, filters, anti-joins, decorrelated aggregates, list functions."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions import columns as C
from stratalog.functions.values import CONS, NUMBER, ATOM, NUMERIC, Atom, NumericType, Unsupported, canonical_number, holds, is_subtype, join_types, joined_number, key_of, list_of, split_number, text_of, type_of, value_of
from stratalog.functions.values import _read as read_key
from stratalog.plans.ir import Arith, Cell, Compare, Const, Goal, Rel, SetOf, Term, TypeTest, Var, goal_vars, term_vars

_fresh = itertools.count()


def fresh(prefix: str = "x") -> str:
    return f"{prefix}{next(_fresh)}"


@dataclass
class Relation:
    """Facts of one predicate: columns c0, c1, ... of the given types, each row once; ``unique``: that it is so is known."""

    df: DataFrame
    types: tuple
    unique: bool = False


@dataclass
class Bindings:
    """Rows of variable bindings. ``env``: variable -> (column, type)."""

    df: DataFrame
    env: dict[str, tuple[str, object]]
    unit: bool = False


def spark_type(t: object) -> T.DataType:
    if isinstance(t, tuple):
        return T.ArrayType(spark_type(t[1]))
    return {"atom": T.StringType(), "int": T.LongType(), "number": T.DoubleType(), "real": C.REAL, "any": T.BinaryType(), "never": T.LongType()}[t]


def lifted(v: object, t: object) -> object:
    """A Spark value of a column of type ``t`` as a domain value."""
    if isinstance(t, tuple):
        return tuple(lifted(x, t[1]) for x in v)
    if t == "atom":
        return Atom(v)
    if t == "any":
        return value_of(bytes(v))
    return joined_number(*v) if t == "real" else canonical_number(v)


def lowered(v: object, t: object) -> object:
    """A domain value as the Spark value of a column of type ``t``."""
    if t == "any":
        return bytearray(key_of(v))
    if isinstance(t, tuple):
        return [lowered(x, t[1]) for x in v]
    if t == "real":
        return split_number(v)
    if t == "number":
        return float(v)
    return str(v) if isinstance(v, Atom) else v


def empty_list(t: object) -> Column:
    return F.slice(F.array(F.lit(None).cast(spark_type(t[1]))), 1, 0)


def constant(v: object, t: object | None = None) -> Column:
    t = type_of(v) if t is None else t
    if isinstance(t, tuple):
        items = [constant(x, t[1]) for x in v]
        return F.array(*items) if items else empty_list(t)
    if t == "real":
        near, rest = split_number(v)
        return F.struct(F.lit(near).alias("near"), F.lit(rest).cast("long").alias("rest"))
    return F.lit(bytes(key_of(v)) if t == "any" else lowered(v, t)).cast(spark_type(t))


def converted(c: Column, a: object, b: object, inside: bool = False) -> Column:
    """A column of type ``a`` as the wider type ``b``, by Spark's functions alone. ``inside``: within a lambda."""
    if a == b:
        return c
    if isinstance(a, tuple):
        if b == "any":
            return C.key_of_list(converted(c, a, list_of("any"), inside))
        if a[1] == "never":
            return empty_list(b)
        if b[1] == "any" and a[1] in NUMERIC and not inside:
            return C.keys_of_numbers(c, a[1])
        return F.transform(c, lambda x: converted(x, a[1], b[1], True))
    if a == "never":
        return F.lit(None).cast(spark_type(b))
    if b == "any":
        return C.key_of_atom(c) if a == "atom" else C.key_of_real(converted(c, a, "real", inside), inside)
    if b == "real":
        return (C.real_of_int if a == "int" else C.real_of_double)(c, inside)
    return c.cast(spark_type(b))


def rendered(c: Column, t: object) -> Column:
    """Canonical text of lists and of mixed values; scalars as they are."""
    if not isinstance(t, tuple) and t not in ("any", "real"):
        return c
    return _text(c, t) if _plain(t) else F.udf(lambda k: None if k is None else text_of(value_of(bytes(k))), "string", useArrow=True)(converted(c, t, "any"))


def _plain(t: object) -> bool:
    return _plain(t[1]) if isinstance(t, tuple) else t in ("int", "atom", "never")


def _text(c: Column, t: object) -> Column:
    if isinstance(t, tuple):
        return F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: _text(x, t[1])), ", "), F.lit("]"))
    return C.atom_text(c) if t == "atom" else c.cast("string")


def _kind(t: object) -> str:
    return "list" if isinstance(t, tuple) else "number" if t in NUMERIC else t


def equal(a: Column, ta: object, b: Column, tb: object) -> Column:
    if "any" not in (ta, tb) and _kind(ta) != _kind(tb) and "never" not in (ta, tb):
        return F.lit(False)
    t = join_types(ta, tb)
    return converted(a, ta, t) == converted(b, tb, t)


def fitting(t: Term, kind: object) -> tuple[Column, object] | None:
    """A numeric constant as a literal of a column's own type, so that a filter with it reaches the scan."""
    if isinstance(t, Const) and not isinstance(t.value, (Atom, tuple)) and isinstance(t.value, (int, float)):
        if kind == "number" and float(t.value) == t.value and abs(t.value) <= 1 << 53:
            return F.lit(float(t.value)), "number"
    return None


class Compiler:
    """Turns goals into plans. ``lookup`` gives a goal's relation (None: no facts); ``functions`` the recognised list
    functions; in a query ``strict`` makes non-numeric operands an error, in rules the goal fails."""

    def __init__(self, spark: SparkSession, lookup: Callable[[Rel], Relation | None], functions: dict[tuple[str, int], str], strict: bool):
        self.spark, self.lookup, self.functions, self.strict = spark, lookup, functions, strict

    # -- terms ---------------------------------------------------------------------------------------------------

    def term(self, env: dict, t: Term) -> tuple[Column, object]:
        if isinstance(t, Var):
            name, kind = env[t.name]
            return F.col(name), kind
        if isinstance(t, Const):
            kind = type_of(t.value)
            return constant(t.value, kind), kind
        parts, rest = [], t
        while isinstance(rest, Cell):
            parts.append(self.term(env, rest.head))
            rest = rest.tail
        if isinstance(rest, Const) and rest.value == ():
            kind = "never"
            for _, k in parts:
                kind = join_types(kind, k)
            return F.array(*[converted(c, k, kind) for c, k in parts]), list_of(kind)
        head, th = self.term(env, t.head)
        tail, tt = self.term(env, t.tail)
        if isinstance(tt, tuple):
            kind = join_types(th, tt[1])
            return F.concat(F.array(converted(head, th, kind)), converted(tail, tt, list_of(kind))), list_of(kind)
        return F.concat(F.lit(bytes([CONS])), converted(head, th, "any"), converted(tail, tt, "any")), "any"

    def known(self, env: dict, t: Term) -> bool:
        return all(v in env for v in term_vars(t))

    def unify(self, b: Bindings, t: Term, c: Column, kind: object) -> Bindings:
        """Keep rows where the column's value matches the term; bind its new variables."""
        if self.known(b.env, t):
            mine, k = fitting(t, kind) or self.term(b.env, t)
            return Bindings(b.df.where(equal(mine, k, c, kind)), b.env)
        if isinstance(t, Var):
            name = fresh()
            return Bindings(b.df.withColumn(name, c), b.env | {t.name: (name, kind)})
        head, tail = fresh(), fresh()
        if isinstance(kind, tuple):
            df = b.df.where(F.size(c) > 0).withColumn(head, F.element_at(c, 1)).withColumn(tail, F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))))
            th, tt = kind[1], kind
        elif kind == "any":
            # how long the head's key is; the rest of the pair is its tail's
            size = F.udf(lambda k: None if k is None else read_key(bytes(k), 1)[1] - 1, "int", useArrow=True)
            long = fresh()
            df = b.df.where(C.tag_is(c, CONS)).withColumn(long, size(c))
            df = df.withColumn(head, F.substring(c, F.lit(2), F.col(long))).withColumn(tail, F.substring(c, F.col(long) + 2, F.length(c))).drop(long)
            th = tt = "any"
        else:
            df, th, tt = b.df.where(F.lit(False)).withColumn(head, F.lit(0).cast("long")).withColumn(tail, F.array().cast("array<bigint>")), "never", list_of("never")
        b = self.unify(Bindings(df, b.env), t.head, F.col(head), th)
        return self.unify(b, t.tail, F.col(tail), tt)

    # -- goals ---------------------------------------------------------------------------------------------------

    def body(self, goals: tuple[Goal, ...], start: Bindings | None = None, needed: set[str] | None = None) -> Bindings | None:
        """All goals in their order; None if a relation without facts makes the body fail.

        ``needed``: the variables that matter afterwards (None: all). A collected list that only its length, sum or
        first element is taken of isn't built.
        """
        b = start or Bindings(self.spark.range(1).select(F.lit(1).alias(fresh("u"))), {}, True)
        waiting = list(goals)
        while waiting:
            k = next((k for k, g in enumerate(waiting) if self.ready(b, g, waiting[:k])), None)
            unbound = k is None
            if unbound:
                # a list function that nothing gives a list to ranges over all lists there are
                k = next((k for k, g in enumerate(waiting) if isinstance(g, Rel) and not g.negated), None)
                if k is None:
                    raise Unsupported(f"{waiting[0]}: nothing binds its variables")
            g = waiting.pop(k)
            if unbound:
                b = self.present(b, g)
                if b is None:
                    return None
                continue
            fused = self.fusible(b, g, waiting, needed) if isinstance(g, SetOf) else None
            if fused is not None:
                how, out, other = fused
                if other is not None:
                    waiting.remove(other)
                b = self.aggregate(b, g, how, out)
            elif isinstance(g, Rel) and not g.negated and g.key not in self.functions and (band := self.band(b, g, waiting)):
                b = self.near(b, g, *band)
            else:
                b = self.goal(b, g)
            if b is None:
                return None
        return b

    def fusible(self, b: Bindings, g: SetOf, waiting: list[Goal], needed: set[str] | None) -> tuple[str, Term, Goal | None] | None:
        """Which aggregate stands for the list, the term it binds, and the goal that asked for it."""
        if isinstance(g.result, Const) and g.result.value == ():
            return "none", g.result, None
        if needed is None:
            return None
        used = [x for x in waiting if isinstance(g.result, Var) and g.result.name in goal_vars(x)]
        if isinstance(g.result, Var) and g.result.name not in needed and g.result.name not in b.env and len(used) == 1:
            use = used[0]
            shape = self.functions.get(use.key) if isinstance(use, Rel) and not use.negated else None
            if shape in ("length", "sum") and use.args[0] == g.result and g.result.name not in term_vars(use.args[1]):
                return shape, use.args[1], use
        if isinstance(g.result, Cell) and isinstance(g.result.tail, Var):
            tail = g.result.tail.name
            if tail not in needed and tail not in b.env and tail not in term_vars(g.result.head) and not any(tail in goal_vars(x) for x in waiting):
                return "least", g.result.head, None
        return None

    def band(self, b: Bindings, g: Rel, waiting: list[Goal]) -> tuple[str, str, bool, float] | None:
        """A join on a distance: variables l and r of the two sides, which of them is bound, and how far apart they may be.

        Looks for ``l < r``, ``D = r - l`` and ``D < limit``.
        """
        if b.unit or any(v in b.env for v in goal_vars(g)):
            return None
        mine = set(goal_vars(g))
        below = {(x.left.name, x.right.name) for x in waiting if isinstance(x, Compare) and x.op in ("<", "<=") and not x.negated and isinstance(x.left, Var) and isinstance(x.right, Var)}
        limits = {x.left.name: x.right.value for x in waiting if isinstance(x, Compare) and x.op in ("<", "<=") and not x.negated and isinstance(x.left, Var) and isinstance(x.right, Const) and isinstance(x.right.value, (int, float)) and x.right.value > 0}
        for x in waiting:
            if isinstance(x, Arith) and x.op == "-" and isinstance(x.out, Var) and x.out.name in limits and isinstance(x.left, Var) and isinstance(x.right, Var):
                low, high = x.right.name, x.left.name
                for bound, new in ((low, high), (high, low)):
                    if (low, high) in below and bound in b.env and new in mine and new not in b.env and b.env[bound][1] in ("int", "number"):
                        return low, high, bound == low, float(limits[x.out.name])
        return None

    def near(self, b: Bindings, g: Rel, low: str, high: str, bound_is_low: bool, limit: float) -> Bindings | None:
        """Both sides meet by bins as wide as the limit, so only neighbours are compared; the goals that say so filter later."""
        r = self.lookup(g)
        if r is None:
            return None
        side = self.matched(g, r)
        mine, theirs = (b.env[low], side.env[high]) if bound_is_low else (b.env[high], side.env[low])
        if theirs[1] not in ("int", "number"):
            return self.present(b, g)
        bin_, other = fresh("b"), fresh("b")
        at = lambda c: F.floor(F.col(c).cast("double") / F.lit(limit))
        step = 1 if bound_is_low else -1
        # rounding may move a value to the next bin, so one more on each side is looked at
        places = F.array(*[at(mine[0]) + k * step for k in (-1, 0, 1, 2)])
        df = b.df.withColumn(bin_, F.explode(places)).join(side.df.withColumn(other, at(theirs[0])), F.col(bin_) == F.col(other)).drop(bin_, other)
        return Bindings(df, b.env | side.env)

    def ready(self, b: Bindings, g: Goal, before: list[Goal]) -> bool:
        """List functions wait for their list, and what reads their results waits for them."""
        if isinstance(g, Rel) and g.key in self.functions:
            return self.known(b.env, g.args[1 if self.functions[g.key] == "member" else 0])
        if isinstance(g, SetOf):
            inner = {v for x in g.goals for v in goal_vars(x)} | set(term_vars(g.template))
            return not any(v in inner and v not in b.env for x in before for v in goal_vars(x, inside=False))
        if isinstance(g, Arith):
            return self.known(b.env, g.left) and self.known(b.env, g.right)
        if isinstance(g, Compare) and g.op == "=" and not g.negated:
            return self.known(b.env, g.left) or self.known(b.env, g.right)
        return isinstance(g, Rel) and not g.negated or all(v in b.env for v in goal_vars(g))

    def goal(self, b: Bindings, g: Goal) -> Bindings | None:
        if isinstance(g, Rel):
            if g.key in self.functions:
                return self.function(b, g, self.functions[g.key])
            return self.absent(b, g) if g.negated else self.present(b, g)
        if isinstance(g, SetOf):
            return self.aggregate(b, g)
        if isinstance(g, Arith):
            return self.arithmetic(b, g)
        if isinstance(g, TypeTest):
            c, kind = self.term(b.env, g.term)
            test = self.has_type(c, kind, g.type)
            return Bindings(b.df.where(~test if g.negated else test), b.env)
        return self.comparison(b, g)

    def matched(self, g: Rel, r: Relation) -> Bindings:
        """The relation's rows that fit the goal's patterns, with the goal's variables bound."""
        names = [fresh("r") for _ in r.types]
        side = Bindings(r.df.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)]), {})
        for t, n, kind in zip(g.args, names, r.types):
            side = self.unify(side, t, F.col(n), kind)
        return Bindings(side.df.select(*[F.col(n) for n, _ in side.env.values()]) if side.env else side.df.select(F.lit(1).alias(fresh("u"))), side.env)

    def on(self, b: Bindings, side: Bindings) -> Column:
        out = None
        for v in (v for v in side.env if v in b.env):
            (mine, k1), (theirs, k2) = b.env[v], side.env[v]
            same = equal(F.col(mine), k1, F.col(theirs), k2)
            out = same if out is None else out & same
        return out if out is not None else F.lit(True)

    def present(self, b: Bindings, g: Rel) -> Bindings | None:
        r = self.lookup(g)
        if r is None:
            return None
        side = self.matched(g, r)
        new = [v for v in side.env if v not in b.env]
        if b.unit:
            return Bindings(side.df, side.env, not side.env)
        if not new:
            return Bindings(b.df.join(side.df, self.on(b, side), "left_semi"), b.env)
        shared = [side.env[v][0] for v in side.env if v in b.env]
        df = b.df.join(side.df, self.on(b, side)) if shared else b.df.crossJoin(side.df)
        return Bindings(df.drop(*shared), b.env | {v: side.env[v] for v in new})

    def absent(self, b: Bindings, g: Rel) -> Bindings:
        r = self.lookup(g)
        if r is None:
            return b
        side = self.matched(g, r)
        return Bindings(b.df.join(side.df, self.on(b, side), "left_anti"), b.env)

    def comparison(self, b: Bindings, g: Compare) -> Bindings:
        if g.op == "=" and not g.negated:
            left, right = (g.left, g.right) if self.known(b.env, g.right) else (g.right, g.left)
            c, kind = self.term(b.env, right)
            return self.unify(b, left, c, kind)
        (x, tx), (y, ty) = self.term(b.env, g.left), self.term(b.env, g.right)
        if g.op in ("=", "!="):
            test = equal(x, tx, y, ty)
            test = ~test if (g.op == "!=") != g.negated else test
            return Bindings(b.df.where(test), b.env)
        x, tx = fitting(g.left, ty) or self.number(x, tx)
        y, ty = fitting(g.right, tx) or self.number(y, ty)
        if tx != ty or tx not in ("int", "number"):
            x, y = converted(x, tx, "real"), converted(y, ty, "real")
        test = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[g.op]
        return Bindings(b.df.where(~test if g.negated else test), b.env)

    def number(self, c: Column, kind: object) -> tuple[Column, object]:
        """The column as a number and its type; elsewhere null in rules, so the goal fails, and an error in queries."""
        if kind in NUMERIC:
            return c, kind
        if kind == "never":
            return c, "int"
        if kind != "any":
            if self.strict:
                raise NumericType("a number was needed")
            return F.lit(None).cast("long"), "int"
        got = C.real_of_key(c)
        return (F.coalesce(got, F.raise_error(F.lit("NumericType")).cast(C.REAL)) if self.strict else got), "real"

    def arithmetic(self, b: Bindings, g: Arith) -> Bindings:
        """Integers exactly, within 64 bits; with a float among the operands, as doubles. What leaves the range fails, or is an error in a query."""
        (x, tx), (y, ty) = (self.number(*self.term(b.env, t)) for t in (g.left, g.right))
        name = fresh()
        if tx == ty == "int":
            c, kind = self.whole(g.op, x, y), "int"
        elif "real" in (tx, ty):
            x, y = converted(x, tx, "real"), converted(y, ty, "real")
            i, j = C.int_of_real(x), C.int_of_real(y)
            c = F.when(i.isNotNull() & j.isNotNull(), C.real_of_int(self.whole(g.op, i, j))).otherwise(C.real_of_double(self.finite(g.op, x["near"], y["near"])))
            kind = "real"
        else:
            c, kind = self.finite(g.op, x.cast("double"), y.cast("double")), "number"
        df = b.df.withColumn(name, c)
        if not self.strict:
            df = df.where(F.col(name)["near"].isNotNull() if kind == "real" else F.col(name).isNotNull())
        return self.unify(Bindings(df, b.env), g.out, F.col(name), kind)

    def whole(self, op: str, x: Column, y: Column) -> Column:
        if self.strict:
            return x + y if op == "+" else x - y
        return F.try_add(x, y) if op == "+" else F.try_subtract(x, y)

    def finite(self, op: str, x: Column, y: Column) -> Column:
        c = (x + y if op == "+" else x - y) + F.lit(0.0)
        out = F.when(F.abs(c) < F.lit(float("inf")), c)
        return F.when(out.isNull() & c.isNotNull(), F.raise_error(F.lit("OVERFLOW")).cast("double")).otherwise(out) if self.strict else out

    def has_type(self, c: Column, kind: object, t: object, inside: bool = False) -> Column:
        if is_subtype(kind, t):
            return F.lit(True)
        if isinstance(kind, tuple):
            return F.forall(c, lambda x: self.has_type(x, kind[1], t[1], True)) if isinstance(t, tuple) else F.lit(False)
        if kind in NUMERIC:
            return C.is_whole(converted(c, kind, "real", inside), inside) if t == "int" else F.lit(False)
        if kind != "any":
            return F.lit(False)
        if t == "atom":
            return C.tag_is(c, ATOM)
        if t == "int":
            return F.coalesce(C.is_whole(C.real_of_key(c, inside), inside), F.lit(False))
        if t == "number":
            return C.tag_is(c, NUMBER)
        return F.udf(lambda k: k is not None and holds(value_of(bytes(k)), t), "boolean", useArrow=True)(c)

    def aggregate(self, b: Bindings, g: SetOf, how: str = "list", out: Term | None = None) -> Bindings | None:
        """Distinct outer keys meet the inner goals once; groups that find nothing keep an empty list.

        ``how`` says what of the list is wanted: all of it, its length, its sum, its least element, or that there is none.
        These aggregates combine before the shuffle, and lists aren't built for them.
        """
        out = g.result if out is None else out
        inner_vars = {v for x in g.goals for v in goal_vars(x)} | set(term_vars(g.template))
        corr = [v for v in b.env if v in inner_vars]
        keys = [b.env[v][0] for v in corr]
        start = Bindings(b.df.select(*keys).distinct(), {v: b.env[v] for v in corr}) if corr else None
        inner = self.body(g.goals, start, set(corr) | set(term_vars(g.template)))
        name = fresh("s")
        if inner is None:
            empty = {"length": (0, "int"), "sum": (0, "int"), "list": ((), list_of("never"))}.get(how)
            if how == "none":
                return b
            if empty is None:
                return Bindings(b.df.where(F.lit(False)), b.env | {v: (k, "never") for v in term_vars(out) if v not in b.env for k in [next(iter(b.df.columns))]})
            value, kind = empty
            return self.unify(Bindings(b.df.withColumn(name, constant(value, kind)), b.env), out, F.col(name), kind)
        c, element = self.term(inner.env, g.template)
        named = [f"{name}_{i}" for i in range(len(keys))]
        if how == "none":
            found = inner.df.select(*[F.col(inner.env[v][0]).alias(n) for v, n in zip(corr, named)]) if corr else inner.df.limit(1).select(F.lit(1).alias(name))
            return Bindings(b.df.join(found, self._same(keys, named), "left_anti"), b.env)
        if how == "sum" and element not in NUMERIC:
            how = "list of numbers"
        kind: object = list_of(element)
        if how == "length":
            taken, kind, empty = F.count_distinct(c), "int", F.lit(0).cast("long")
        elif how == "least":
            taken, kind, empty = F.min(c), element, None
        elif how == "sum" and element in ("int", "number"):
            inner = Bindings(inner.df.withColumn(f"{name}_v", c), inner.env)
            taken, kind, empty = F.expr(f"try_sum(DISTINCT {name}_v)"), element, F.lit(0).cast(spark_type(element))
        else:
            taken, empty = F.array_sort(F.collect_set(c)), empty_list(kind)
        taken = taken.alias(name)
        if corr:
            # keys keep the names they had outside; groups join back to the rows they came from
            grouped = inner.df.groupBy(*[F.col(inner.env[v][0]).alias(n) for v, n in zip(corr, named)]).agg(taken)
            if how == "sum":
                # a sum outside its range is no answer; a group without members sums to nought
                grouped = grouped.where(F.col(name).isNotNull()) if self.strict else grouped.withColumn(f"{name}_ok", F.col(name).isNotNull())
            df = b.df.join(grouped, self._same(keys, named), "inner" if how == "least" else "left").drop(*named)
            if f"{name}_ok" in df.columns:
                df = df.where(F.coalesce(f"{name}_ok", F.lit(True))).drop(f"{name}_ok")
            if empty is not None:
                df = df.withColumn(name, F.coalesce(name, empty))
        else:
            one = inner.df.agg(taken)
            df = b.df.crossJoin(one.where(F.col(name).isNotNull()) if how == "least" else one.withColumn(name, F.coalesce(name, empty)))
        made = Bindings(df, b.env)
        if how in ("sum", "list of numbers") and isinstance(kind, tuple):
            return self.summed(made, F.col(name), kind, out)
        return self.unify(made, out, F.col(name), kind)

    @staticmethod
    def _same(keys: list[str], named: list[str]) -> Column:
        same = F.lit(True)
        for k, n in zip(keys, named):
            same = same & (F.col(k) == F.col(n))
        return same

    def total(self, c: Column, kind: tuple) -> tuple[Column, object]:
        """A list's sum; lists with other values than numbers, and sums outside the range, have none."""
        element = kind[1]
        if element in ("int", "never"):
            return F.aggregate(c.cast("array<bigint>"), F.lit(0).cast("long"), lambda acc, x: F.try_add(acc, x)), "int"
        if element == "number":
            return F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x), "number"
        if element not in ("real", "any"):
            return F.when(F.size(c) == 0, F.lit(0).cast("long")), "int"
        reals = c if element == "real" else F.transform(c, lambda x: C.real_of_key(x, True))

        def add(acc: Column, x: Column) -> Column:
            i, j = C.int_of_real(acc, True), C.int_of_real(x, True)
            return F.when(i.isNotNull() & j.isNotNull(), C.real_of_int(F.try_add(i, j), True)).otherwise(C.real_of_double(acc["near"] + x["near"]))

        return F.when(~F.exists(reals, lambda x: x.isNull()), F.aggregate(reals, constant(0, "real"), add)), "real"

    def summed(self, b: Bindings, c: Column, kind: tuple, out: Term) -> Bindings:
        name = fresh()
        value, t = self.total(c, kind)
        df = b.df.withColumn(name, value)
        df = df.where(F.col(name)["near"].isNotNull() if t == "real" else F.col(name).isNotNull())
        return self.unify(Bindings(df, b.env), out, F.col(name), t)

    def function(self, b: Bindings, g: Rel, shape: str) -> Bindings | None:
        """length, sum, member and collectfirst of a bound list, without recursion; of other values, from the relation."""
        at = 1 if shape == "member" else 0
        c, kind = self.term(b.env, g.args[at])
        if not isinstance(kind, tuple):
            return self.absent(b, g) if g.negated else self.present(b, g)
        if shape == "member":
            if g.negated:
                x, tx = self.term(b.env, g.args[0])
                t = join_types(tx, kind[1])
                return Bindings(b.df.where(~F.array_contains(converted(c, kind, list_of(t)), converted(x, tx, t))), b.env)
            name = fresh()
            df = b.df.withColumn(name, F.explode(F.array_distinct(c)))
            return self.unify(Bindings(df, b.env), g.args[0], F.col(name), kind[1])
        name = fresh()
        value, t = self.taken(shape, c, kind)
        there = lambda c: F.col(c)["near"].isNotNull() if t == "real" else F.col(c).isNotNull()
        df = b.df.withColumn(name, value)
        if g.negated:
            mine, k = self.term(b.env, g.args[1])
            return Bindings(df.where(~there(name) | ~equal(mine, k, F.col(name), t)).drop(name), b.env)
        return self.unify(Bindings(df.where(there(name)), b.env), g.args[1], F.col(name), t)

    def taken(self, shape: str, c: Column, kind: tuple) -> tuple[Column, object]:
        """A list function's value and type; null where it has none."""
        if shape == "length":
            return F.size(c).cast("long"), "int"
        if shape == "sum":
            return self.total(c, kind)
        inner = kind[1]
        if isinstance(inner, tuple):
            fits = F.forall(c, lambda x: F.size(x) == 2)
            return F.when(fits, F.transform(c, lambda x: F.element_at(x, 1))), list_of(inner[1])
        if inner == "any":
            raise Unsupported("collectfirst needs pairs of one type")
        return F.when(F.size(c) == 0, empty_list(list_of("never"))), list_of("never")

    # -- heads ---------------------------------------------------------------------------------------------------

    def head(self, b: Bindings, head: Rel) -> Relation:
        cols = [self.term(b.env, t) for t in head.args]
        df = b.df.select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cols)]) if cols else b.df.select(F.lit(1).alias("c_"))
        return Relation(df, tuple(k for _, k in cols))


def widened(r: Relation, types: tuple) -> DataFrame:
    return r.df.select(*[converted(F.col(f"c{i}"), a, b).alias(f"c{i}") for i, (a, b) in enumerate(zip(r.types, types))]) if types else r.df


def union(relations: list[Relation]) -> Relation:
    """Union under the smallest common column types; rows may repeat."""
    types = relations[0].types
    for r in relations[1:]:
        types = tuple(map(join_types, types, r.types))
    df = widened(relations[0], types)
    for r in relations[1:]:
        df = df.unionAll(widened(r, types))
    return Relation(df, types)
