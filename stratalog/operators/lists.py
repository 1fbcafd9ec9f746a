"""Structural recursion: the lists there are, and rules that walk them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions import columns as C
from stratalog.functions.values import CONS, Pair, join_types, key_of, type_of, value_of
from stratalog.operators.body import Relation, constant, converted, spark_type
from stratalog.plans.check import given_position
from stratalog.plans.ir import Cell, Compare, Const, Goal, Rel, Rule, SetOf, Term, Var

#: The relation of all non-empty lists and pairs in the facts, with their tails and the lists inside them.
LISTS = ("$list", 1)


def seeded(rule: Rule) -> Rule:
    """A rule whose head takes a list apart that its body doesn't bind, with that list taken from all there are.

    Every call of a structural rule is on a tail, which is a list of its own, so the relation is finite and
    the ordinary rounds end after as many as the longest list has elements.
    """
    at = given_position(rule)
    if at is None:
        return rule
    whole = Var(f"$L{at}")
    args = [whole if i == at else t for i, t in enumerate(rule.head.args)]
    return Rule(Rel(rule.head.name, tuple(args)), (Rel(LISTS[0], (whole,)), Compare("=", whole, rule.head.args[at]), *rule.body))


def list_constants(goals: tuple[Goal, ...]) -> set:
    """Non-empty lists and pairs written out in goals."""
    out: set = set()

    def term(t: Term) -> None:
        if isinstance(t, Const) and (isinstance(t.value, Pair) or isinstance(t.value, tuple) and t.value):
            out.add(t.value)
        elif isinstance(t, Cell):
            term(t.head)
            term(t.tail)

    for g in goals:
        if isinstance(g, SetOf):
            out |= list_constants(g.goals)
        for t in [*getattr(g, "args", ()), *(getattr(g, n, None) for n in ("left", "right", "out", "template", "result", "term"))]:
            if t is not None:
                term(t)
    return out


def cells(key: bytes) -> list[bytes]:
    """The keys of a value's non-empty lists and pairs: itself, its tails, and those inside."""
    found, todo = set(), [value_of(bytes(key))]
    while todo:
        v = todo.pop()
        if isinstance(v, tuple) and v or isinstance(v, Pair):
            k = key_of(v)
            if k not in found:
                found.add(k)
                todo += [v[0], v[1:]] if isinstance(v, tuple) else [v.head, v.tail]
    return [bytearray(k) for k in found]


def universe(spark: SparkSession, relations: list[Relation], values: set) -> Relation | None:
    """One column: every list and pair in the relations and among the values, with their parts.

    Lists of one flat element type keep it and are cut by Spark's functions; others go by their keys.
    """
    columns = [(r.df, f"c{i}", t) for r in relations for i, t in enumerate(r.types) if t == "any" or isinstance(t, tuple)]
    kind: object = "never"
    for t in [t for _, _, t in columns] + [type_of(v) for v in values]:
        kind = join_types(kind, t)
    if kind == "never":
        return None
    flat = isinstance(kind, tuple) and not isinstance(kind[1], tuple) and kind[1] != "any"
    kind = kind if flat else "any"
    frames: list[DataFrame] = [df.select(converted(F.col(c), t, kind).alias("c0")) for df, c, t in columns]
    if values:
        rows = spark.range(1).select(F.explode(F.array(*[constant(v, kind) for v in sorted(values, key=key_of)])).alias("c0"))
        frames.append(rows)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionAll(f)
    if flat:
        tails = F.transform(F.sequence(F.lit(1), F.size("c0")), lambda i: F.slice("c0", i, F.size("c0")))
        out = out.where(F.size("c0") > 0).distinct().select(F.explode(tails).alias("c0"))
    else:
        out = out.where(C.tag_is(F.col("c0"), CONS)).distinct().select(F.explode(F.udf(cells, T.ArrayType(T.BinaryType()), useArrow=True)("c0")).alias("c0"))
    assert out.schema["c0"].dataType == spark_type(kind)
    return Relation(out.distinct(), (kind,))


