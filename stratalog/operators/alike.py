"""Recursion over values that are alike: one of them goes the rounds, and its facts are spread over all at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators.blocks import blocked, spread, tasks
from stratalog.operators.body import Relation, fresh
from stratalog.operators.fixpoint import CompilerFor, Key, kept, semi_naive
from stratalog.plans.ir import Const, Goal, Rel, Rule, SetOf, Var, goal_vars

#: A predicate and the column of it that a head's variable comes from.
Source = tuple[Key, int]


def sources(rules: list[Rule], part: list[Key], barred: set[Key]) -> list[Source] | None:
    """Where the values at each place of the component's one predicate come from, if every rule takes the variable
    there from the same column of one goal outside and says nothing else of it. Values whose only row in that column's
    predicate says the same are then in the same facts.
    """
    if len(part) != 1 or not part[0][1]:
        return None
    found: list[Source | None] = [None] * part[0][1]
    for rule in rules:
        if any(isinstance(g, SetOf) or isinstance(g, Rel) and (g.key in barred or not all(isinstance(t, (Var, Const)) for t in g.args)) for g in rule.body):
            return None
        if not all(isinstance(t, Var) for t in rule.head.args) or len(set(rule.head.args)) != len(rule.head.args):
            return None
        for i, x in enumerate(rule.head.args):
            said = [g for g in rule.body if x.name in goal_vars(g)]
            if len(said) != 1 or not isinstance(said[0], Rel) or said[0].negated or said[0].key == part[0] or len(said[0].args) < 2 or said[0].args.count(x) != 1:
                return None
            if any(y in said[0].args for y in rule.head.args if y != x):
                return None
            source = said[0].key, said[0].args.index(x)
            if found[i] not in (None, source):
                return None
            found[i] = source
    return found


def classes(df: DataFrame, at: str) -> DataFrame:
    """Each value of column ``at`` and the one that stands for it: the least of those whose only row says the same, else itself."""
    rest = [c for c in df.columns if c != at]
    value, stands = fresh("v"), fresh("v")
    least, most = {c: fresh("v") for c in rest}, {c: fresh("v") for c in rest}
    rows = df.groupBy(F.col(at).alias(value)).agg(*[F.min(c).alias(least[c]) for c in rest], *[F.max(c).alias(most[c]) for c in rest])
    alone = F.lit(True)
    for c in rest:
        alone = alone & (F.col(least[c]) == F.col(most[c]))
    keys = [least[c] for c in rest]
    single = rows.where(alone).select(value, *keys)
    firsts = single.groupBy(*keys).agg(F.min(value).alias(stands))
    out = single.join(firsts, keys).select(F.col(value).alias("c0"), F.col(stands).alias("c1"))
    return out.unionAll(rows.where(~alone).select(F.col(value).alias("c0"), F.col(value).alias("c1")))


def by_classes(compiler_for: CompilerFor, rules: list[Rule], part: list[Key], came: list[Source], relation: Callable[[Key], Relation | None], folder: str) -> dict[Key, Relation] | None:
    """The component's facts, worked out on one value of each class; None if classes would spare less than half of the facts.

    Rounds, and what they write and compare, are of classes; the facts themselves are made where they are read.
    """
    p = part[0]
    stand: dict[Source, Relation] = {}
    few: dict[Source, Relation] = {}
    left = 1.0
    for source in dict.fromkeys(came):
        r = relation(source[0])
        if r is None:
            return None
        at, kind = f"c{source[1]}", r.types[source[1]]
        df, n = kept(classes(r.df, at), folder, f"classes-{len(stand)}")
        firsts = df.where("c0 = c1").select(F.col("c0").alias(at))
        rows = firsts.count()
        left *= (rows / n if n else 1) ** came.count(source)
        stand[source] = Relation(df, (kind, kind))
        few[source] = Relation(r.df.join(firsts, at, "left_semi").select(*r.df.columns), r.types)
    if left > 0.5:
        return None
    few = {s: Relation(kept(r.df, folder, f"few-{k}")[0], r.types) for k, (s, r) in enumerate(few.items())}
    names = {s: k for k, s in enumerate(stand)}
    extra: dict[Key, Relation] = {}
    for s in stand:
        extra[f"$few{names[s]}", s[0][1]] = few[s]
        extra[f"$stands{names[s]}", 2] = stand[s]
    mine = (f"${p[0]}", p[1])
    made = semi_naive(
        lambda lookup, keys: compiler_for(lambda g: extra[g.key] if g.key in extra else lookup(g), keys | set(extra)),
        [Rule(Rel(mine[0], r.head.args), tuple(g for x in r.body for g in _of_classes(x, r.head, p, mine[0], came, names))) for r in rules], [mine], {}, folder,
    )
    if mine not in made:
        return {}
    df, types = made[mine].df, made[mine].types
    if types != tuple(stand[s].types[0] for s in came):
        return None
    lists = []
    for i, s in enumerate(came):
        held = blocked(stand[s].df.select(F.col("c0").alias(f"m{i}"), F.col("c1").alias(f"c{i}")), [f"c{i}"], f"l{i}")
        df = df.join(kept(held, folder, f"blocks-{i}")[0], f"c{i}").drop(f"c{i}")
        lists.append(f"l{i}")
    df, blocks = kept(df, folder, "pairs")
    df = spread(df, lists, tasks(df, blocks)).select(*[F.col(f"m{i}").alias(f"c{i}") for i in range(p[1])])
    return {p: Relation(df, types, True)}


def _of_classes(g: Goal, head: Rel, p: Key, name: str, came: list[Source], names: dict[Source, int]) -> list[Goal]:
    """A rule's goal over classes: heads' variables range over values that stand for others, and facts are asked of these."""
    if not isinstance(g, Rel) or g.negated:
        return [g]
    if g.key == p:
        them = [Var(fresh("$A")) for _ in g.args]
        asked = [Rel(f"$stands{names[s]}", (t, a)) for t, a, s in zip(g.args, them, came)]
        return [asked[0], Rel(name, tuple(them)), *asked[1:]]
    at = next((i for i, x in enumerate(head.args) if x in g.args), None)
    return [g] if at is None else [Rel(f"$few{names[came[at]]}", g.args)]
