"""Rules that pair what two goals say: their facts may grow with the square, so no distinct goes over them where none is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.blocks import blocked, spread, tasks
from stratalog.operators.body import Bindings, Compiler, Relation, fresh, union
from stratalog.plans.ir import Arith, Compare, Goal, Rel, Rule, TypeTest, Var, goal_vars, term_vars


def paired(compiler: Compiler, rule: Rule) -> Relation | None:
    """The rule's facts, if its head takes some variables from one goal and the others from another; else None.

    A head value with one row on its side, as keys have, is in one combination with such a value of the other side, so
    these come once as they are. A distinct goes over what else there is: pairs in which a value has several rows.
    """
    sides = [g for g in rule.body if isinstance(g, Rel)]
    others = [g for g in rule.body if not isinstance(g, Rel)]
    if len(sides) != 2 or any(g.negated or g.key in compiler.functions for g in sides) or not all(isinstance(g, (Compare, Arith, TypeTest)) for g in others):
        return None
    if not all(isinstance(t, Var) for t in rule.head.args) or len(set(rule.head.args)) != len(rule.head.args):
        return None
    heads = [[v.name for v in rule.head.args if v.name in goal_vars(g)] for g in sides]
    if not all(heads) or len(heads[0]) + len(heads[1]) != len(rule.head.args) or set(heads[0]) & set(heads[1]):
        return None
    if any(_equates(g, *map(goal_vars, sides)) for g in others):
        return None
    shared = [v for v in goal_vars(sides[0]) if v in goal_vars(sides[1])]
    asked = {v for g in others for v in goal_vars(g)} | set(shared)
    relations = [compiler.lookup(g) for g in sides]
    if None in relations:
        return None
    found = [compiler.matched(g, r) for g, r in zip(sides, relations)]
    rests = [[v for v in b.env if v in asked and v not in h] for b, h in zip(found, heads)]
    in_blocks = bool(shared) and all(found[0].env[v][1] == found[1].env[v][1] for v in shared)
    once, more, every = ([f(b, h, r, not in_blocks) for b, h, r in zip(found, heads, rests)] for f in (_once, _more, _every))

    if in_blocks:
        lists = [blocked(b.df.select(*[F.col(b.env[v][0]).alias(v) for v in b.env]), shared, n) for b, n in zip(once, ("$left", "$right"))]
        df = lists[0].join(lists[1], shared)
        df = spread(df, ["$left", "$right"], tasks(df))
        types = {v: t for b in once for v, (_, t) in b.env.items()}
        clean = _of_goals(compiler, rule, sides, [Bindings(df, {v: (v, t) for v, t in types.items()})])
    else:
        clean = _of_goals(compiler, rule, sides, once)
    rest = union([_of_goals(compiler, rule, sides, both) for both in ([more[0], every[1]], [once[0], more[1]])])
    out = union([clean, Relation(rest.df.distinct(), rest.types)])
    return Relation(out.df, out.types, True)


def _equates(g: Goal, left: list[str], right: list[str]) -> bool:
    """Whether a goal makes a join of equals of the two sides, which has no need of blocks."""
    if isinstance(g, Arith):
        return any(v in left or v in right for v in term_vars(g.out))
    said = goal_vars(g)
    return isinstance(g, Compare) and g.op == "=" and any(v in left for v in said) and any(v in right for v in said)


def _rows(b: Bindings, heads: list[str], rest: list[str]) -> tuple[DataFrame, list[str], list[str], dict]:
    env = {v: b.env[v] for v in [*heads, *rest]}
    return b.df.select(*[F.col(n) for n, _ in env.values()]), [b.env[v][0] for v in heads], [b.env[v][0] for v in rest], env


def _grouped(df: DataFrame, heads: list[str], rest: list[str]) -> tuple[DataFrame, dict[str, str], object]:
    """For each head value the least and the most of the rest, and whether all of its rows say the same."""
    most = {c: fresh("v") for c in rest}
    out = df.groupBy(*heads).agg(*[F.min(c).alias(c) for c in rest], *[F.max(c).alias(m) for c, m in most.items()])
    alone = F.lit(True)
    for c, m in most.items():
        alone = alone & (F.col(c) == F.col(m))
    return out, most, alone


def _once(b: Bindings, heads: list[str], rest: list[str], deal: bool) -> Bindings:
    """Head values with one row. ``deal``: into so many tasks as pairs need, for nothing after this deals them out."""
    df, keys, values, env = _rows(b, heads, rest)
    if deal:
        df = df.repartition(tasks(df), *keys)
    if not values:
        return Bindings(df.distinct(), env)
    out, _, alone = _grouped(df, keys, values)
    return Bindings(out.where(alone).select(*df.columns), env)


def _more(b: Bindings, heads: list[str], rest: list[str], deal: bool) -> Bindings:
    """Rows of head values with several."""
    df, keys, values, env = _rows(b, heads, rest)
    if not values:
        return Bindings(df.where(F.lit(False)), env)
    out, _, alone = _grouped(df, keys, values)
    names = {k: fresh("k") for k in keys}
    out = out.where(~alone).select(*[F.col(k).alias(n) for k, n in names.items()])
    same = F.lit(True)
    for k, n in names.items():
        same = same & (F.col(k) == F.col(n))
    return Bindings(df.distinct().join(out, same, "left_semi"), env)


def _every(b: Bindings, heads: list[str], rest: list[str], deal: bool) -> Bindings:
    df, _, _, env = _rows(b, heads, rest)
    return Bindings(df.distinct(), env)


def _of_goals(compiler: Compiler, rule: Rule, sides: list[Rel], given: list[Bindings]) -> Relation:
    """The rule with rows in place of its two goals: one's for each, or those of both joined in place of the first."""
    named = {f"$side{k}": Relation(b.df.select(*[F.col(n).alias(f"c{i}") for i, (n, _) in enumerate(b.env.values())]), tuple(t for _, t in b.env.values())) for k, b in enumerate(given)}
    goals, k = [], 0
    for g in rule.body:
        if not isinstance(g, Rel):
            goals.append(g)
        elif k < len(given):
            goals.append(Rel(f"$side{k}", tuple(map(Var, given[k].env))))
            k += 1
    of = Compiler(compiler.spark, lambda g: named[g.name], compiler.functions, compiler.strict)
    return of.head(of.body(tuple(goals), needed={t.name for t in rule.head.args}), rule.head)
