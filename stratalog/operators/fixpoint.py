"""Recursive predicates: semi-naive rounds of delta joins, doubling for plain transitive closure, and upkeep after changes."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.values import join_types
from stratalog.operators.body import Compiler, Relation, spark_type, union, widened
from stratalog.plans.ir import Rel, Rule, SetOf, Var

Key = tuple[str, int]
#: What a lookup says of a predicate that it leaves to the engine.
OUTSIDE = object()
#: A compiler whose relations of some predicates come from a function.
CompilerFor = Callable[[Callable[[Rel], Relation | None], set], Compiler]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, or below the warehouse where that isn't set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    return f"{base.rstrip('/')}/fixpoint-{uuid.uuid4().hex}"


def kept(df: DataFrame, folder: str, name: str) -> tuple[DataFrame, int]:
    """Cut lineage through a written table, which outlives lost executors; and its rows, counted while they are written."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}"), int(seen.get["n"])


class Growing:
    """A set of facts that only grows: its parts are read together, and written anew as one whenever it has doubled."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name, self.parts, self.rows, self.written, self.df = folder, name, [], 0, 0, None

    def add(self, part: DataFrame, rows: int) -> None:
        self.parts.append(part)
        self.rows += rows
        self.df = part if self.df is None else self.df.unionAll(part)
        if len(self.parts) > 4 and self.rows >= 2 * self.written:
            self.df, self.written = kept(self.df, self.folder, f"{self.name}-all-{uuid.uuid4().hex[:8]}")
            self.parts = [self.df]


def closure_edge(rules: list[Rule], part: list[Key]) -> Rel | None:
    """The edge goal if the rules are exactly ``p(X,Y) :- e(X,Y)`` and one linear step over the same e."""
    if len(part) != 1 or part[0][1] != 2 or len(rules) != 2:
        return None
    base, step = sorted(rules, key=lambda r: len(r.body))
    if len(base.body) != 1 or len(step.body) != 2 or not all(isinstance(g, Rel) and not g.negated and all(isinstance(t, Var) for t in g.args) for g in (*base.body, *step.body)):
        return None
    edge, (a, b) = base.body[0], step.body
    if edge.args != base.head.args or len(edge.args) != 2 or len(set(edge.args)) != 2 or edge.key == part[0] or {a.key, b.key} != {edge.key, part[0]}:
        return None
    x, z = step.head.args if all(isinstance(t, Var) for t in step.head.args) else (None, None)
    for first, second in ((a, b), (b, a)):
        if first.args[0] == x and second.args[1] == z and first.args[1] == second.args[0] and len({x, z, first.args[1]}) == 3:
            return edge
    return None


def doubled(edge: Relation, folder: str) -> Relation:
    """Transitive closure in about log2 of the longest path's rounds; cycles end by set semantics."""
    known = Growing(folder, "known")
    delta, rows = kept(edge.df.select("c0", "c1").distinct(), folder, "delta-0")
    known.add(delta, rows)
    k = 0
    while rows:
        k += 1
        d1 = delta.select(F.col("c0").alias("a"), F.col("c1").alias("m"))
        k2 = known.df.select(F.col("c0").alias("m"), F.col("c1").alias("b"))
        made = d1.join(k2, "m").select("a", "b")
        if k > 1:
            k1 = known.df.select(F.col("c0").alias("a"), F.col("c1").alias("m"))
            made = made.unionAll(k1.join(delta.select(F.col("c0").alias("m"), F.col("c1").alias("b")), "m").select("a", "b"))
        made = made.distinct().toDF("c0", "c1")
        delta, rows = kept(made.join(known.df, ["c0", "c1"], "left_anti"), folder, f"delta-{k}")
        known.add(delta, rows)
    return Relation(known.df, edge.types, True)


def base_empty(spark: SparkSession, types: tuple) -> DataFrame:
    fields = [T.StructField(f"c{i}", spark_type(t)) for i, t in enumerate(types)] or [T.StructField("c_", T.IntegerType())]
    return spark.createDataFrame([], T.StructType(fields))


def stable_types(compiler_for: CompilerFor, rules: list[Rule], mine: set[Key], types: dict[Key, tuple]) -> dict[Key, tuple]:
    """Column types of the component's predicates: they widen until no rule widens them further."""
    for _ in range(2 + 4 * len(rules)):
        before = dict(types)
        for rule in rules:
            def shaped(g: Rel) -> Relation | None:
                t = types.get(g.key)
                return Relation(base_empty(compiler.spark, t), t) if t else None

            compiler = compiler_for(shaped, mine)
            b = compiler.body(rule.body)
            if b is not None:
                got = compiler.head(b, rule.head).types
                types[rule.head.key] = tuple(map(join_types, types[rule.head.key], got)) if rule.head.key in types else got
        if types == before:
            break
    return types


def fired(compiler_for: CompilerFor, rules: list[Rule], full: Callable[[Rel], Relation | None], mine: set[Key], delta: dict[Key, Relation] | None = None) -> dict[Key, list[Relation]]:
    """What the rules give: on everything, or once per goal over a changed predicate, that goal restricted to the change.

    ``full`` gives the relations of ``mine``; all others are found outside.
    """
    made: dict[Key, list[Relation]] = {}
    for rule in rules:
        spots = [None] if delta is None else [g for g in rule.body if isinstance(g, Rel) and not g.negated and g.key in delta]
        for spot in spots:
            compiler = compiler_for(lambda g, spot=spot: delta[g.key] if g is spot else full(g) if g.key in mine else OUTSIDE, mine | set(delta or ()))
            b = compiler.body(rule.body, needed={v for t in rule.head.args for v in _vars(t)})
            if b is not None:
                made.setdefault(rule.head.key, []).append(compiler.head(b, rule.head))
    return made


def _vars(t) -> list[str]:
    from stratalog.plans.ir import term_vars

    return term_vars(t)


def semi_naive(compiler_for: CompilerFor, rules: list[Rule], part: list[Key], base: dict[Key, Relation], folder: str) -> dict[Key, Relation]:
    """All predicates of one recursive component. ``compiler_for(lookup, mine)`` makes a compiler whose other relations are found outside.

    Round 0 evaluates every rule on what is known; each later round evaluates each rule once per recursive goal, that
    goal restricted to the last round's new facts. Rounds are written as parts of their own; no round rewrites what is known.
    """
    mine = set(part)
    types = stable_types(compiler_for, rules, mine, {p: r.types for p, r in base.items() if p in mine})
    known: dict[Key, Growing] = {}
    for p in part:
        if p in base:
            known[p] = Growing(folder, _name(p))
            known[p].add(*kept(widened(base[p], types[p]).distinct(), folder, f"{_name(p)}-base"))

    def full(g: Rel) -> Relation | None:
        return Relation(known[g.key].df, types[g.key]) if g.key in known else None

    grow(compiler_for, rules, mine, types, known, fired(compiler_for, rules, full, mine), full, folder)
    return {p: Relation(known[p].df, types[p], True) for p in part if p in known}


def _name(p: Key) -> str:
    return f"{p[0].strip('$')}-{p[1]}"


def grow(compiler_for: CompilerFor, rules: list[Rule], mine: set[Key], types: dict, known: dict[Key, Growing], made: dict[Key, list[Relation]], full, folder: str) -> int:
    """Rounds from the facts ``made`` on, until one gives nothing new; how many facts came."""
    k = total = 0
    while made:
        delta: dict[Key, Relation] = {}
        for p, found in made.items():
            df = widened(union(found), types[p]).distinct()
            if p in known:
                df = df.join(known[p].df, df.columns, "left_anti")
            df, rows = kept(df, folder, f"{_name(p)}-delta-{k}")
            if rows:
                delta[p] = Relation(df, types[p])
                known.setdefault(p, Growing(folder, _name(p))).add(df, rows)
                total += rows
        k += 1
        made = fired(compiler_for, rules, full, mine, delta) if delta else {}
    return total


def naive(compiler_for: CompilerFor, rules: list[Rule], part: list[Key], base: dict[Key, Relation], folder: str) -> dict[Key, Relation]:
    """The oracle: every rule on everything, again and again, until nothing new comes."""
    mine = set(part)
    types = stable_types(compiler_for, rules, mine, {p: r.types for p, r in base.items() if p in mine})
    known = {p: widened(base[p], types[p]).distinct() for p in part if p in base}
    sizes, k = None, 0
    while True:
        made = fired(compiler_for, rules, lambda g: Relation(known[g.key], types[g.key]) if g.key in known else None, mine)
        now = {}
        for p in part:
            frames = [widened(r, types[p]) for r in made.get(p, [])] + ([known[p]] if p in known else [])
            if frames:
                out = frames[0]
                for f in frames[1:]:
                    out = out.unionAll(f)
                known[p], now[p] = kept(out.distinct(), folder, f"{_name(p)}-naive-{k}")
        if now == sizes:
            return {p: Relation(known[p], types[p]) for p in known}
        sizes, k = now, k + 1


@dataclass
class Upkeep:
    """What maintenance did, in facts and decisions."""

    inserted: int = 0
    overdeleted: int = 0
    rederived: int = 0
    maintained: int = 0
    rebuilt: int = 0
    explored: int = 0
    verified: int = 0
    seconds: dict[str, float] = field(default_factory=dict)


def minus(a: DataFrame, b: DataFrame | None) -> DataFrame:
    return a if b is None else a.join(b, a.columns, "left_anti")


def both(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionAll(b)


def reads_inside(goals: tuple, into: set[Key]) -> set[Key]:
    """Predicates read under negation or inside an aggregate."""
    for g in goals:
        if isinstance(g, SetOf):
            for x in g.goals:
                if isinstance(x, Rel):
                    into.add(x.key)
            reads_inside(g.goals, into)
        elif isinstance(g, Rel) and g.negated:
            into.add(g.key)
    return into


def maintained(
    new_for: CompilerFor, old_for: CompilerFor, rules: list[Rule], part: list[Key], old: dict[Key, Relation], base: dict[Key, Relation],
    inserted: dict[Key, Relation], deleted: dict[Key, Relation], folder: str, upkeep: Upkeep,
) -> dict[Key, Relation] | None:
    """A component's facts after its inputs changed, from those before. None if it has to be rebuilt.

    ``inserted`` and ``deleted``: changes of the predicates that the rules read, and of the component's own base facts, as
    ``base`` has them now. Deletion takes away all that a deleted fact helped to derive, against the facts before;
    then what of it the rest still derives comes back, and insertions go their rounds from there. Costs follow the change:
    every join starts from changed facts, and the facts before are neither sorted nor written again.
    """
    mine = set(part)
    types = {p: r.types for p, r in old.items()}
    if any(p not in types for p in part) or any(tuple(map(join_types, types[p], r.types)) != types[p] for src in (base, inserted, deleted) for p, r in src.items() if p in mine):
        return None
    gone: dict[Key, DataFrame] = {}
    own = {p: widened(r, types[p]) for p, r in base.items()}

    def settle(found: dict[Key, list[Relation]], k: str) -> dict[Key, Relation] | None:
        delta = {}
        for p, made in found.items():
            if tuple(map(join_types, types[p], union(made).types)) != types[p]:
                return None
            df = widened(union(made), types[p]).distinct().join(old[p].df, old[p].df.columns, "left_semi")
            df, rows = kept(minus(minus(df, own.get(p)), gone.get(p)), folder, f"{_name(p)}-gone-{k}")
            if rows:
                gone[p] = both(gone.get(p), df)
                delta[p] = Relation(df, types[p])
                upkeep.overdeleted += rows
        return delta

    delta = settle({p: [r] for p, r in deleted.items() if p in mine}, "own")
    if delta is None:
        return None
    delta |= {e: r for e, r in deleted.items() if e not in mine}
    k = 0
    while delta:
        delta = settle(fired(old_for, rules, lambda g: old.get(g.key), mine, delta), str(k))
        if delta is None:
            return None
        k += 1
    left = {p: minus(old[p].df, gone.get(p)) for p in part}
    known: dict[Key, Growing] = {}

    def full(g: Rel) -> Relation | None:
        if g.key not in mine:
            return None
        df = both(known[g.key].df, left[g.key]) if g.key in known and known[g.key].df is not None else left[g.key]
        return Relation(df, types[g.key])

    made: dict[Key, list[Relation]] = {}
    back = {p: Relation(df, types[p]) for p, df in gone.items()}
    for rule in rules:
        p = rule.head.key
        if p in back:
            asked = Rel(f"$gone {p[0]}", rule.head.args)
            compiler = new_for(lambda g, p=p: back[p] if g.name.startswith("$gone ") else full(g), mine | {asked.key})
            b = compiler.body((asked, *rule.body), needed={v for t in rule.head.args for v in _vars(t)})
            if b is not None:
                made.setdefault(p, []).append(compiler.head(b, rule.head))
    again: dict[Key, Relation] = {}
    for p, found in made.items():
        df, rows = kept(widened(union(found), types[p]).distinct(), folder, f"{_name(p)}-back")
        if rows:
            known[p] = Growing(folder, f"{_name(p)}-new")
            known[p].add(df, rows)
            again[p] = Relation(df, types[p])
            upkeep.rederived += rows
    delta = dict(again)
    for p, r in inserted.items():
        if p not in mine:
            delta[p] = r
            continue
        df, rows = kept(minus(widened(r, types[p]).distinct(), full(Rel(p[0], (None,) * p[1])).df), folder, f"{_name(p)}-put")
        if rows:
            known.setdefault(p, Growing(folder, f"{_name(p)}-new")).add(df, rows)
            delta[p] = Relation(both(again[p].df if p in again else None, df), types[p])
    k = 0
    while delta:
        found = fired(new_for, rules, full, mine, delta)
        delta = {}
        for p, made_ in found.items():
            if tuple(map(join_types, types[p], union(made_).types)) != types[p]:
                return None
            df = minus(widened(union(made_), types[p]).distinct(), full(Rel(p[0], (None,) * p[1])).df)
            df, rows = kept(df, folder, f"{_name(p)}-more-{k}")
            if rows:
                known.setdefault(p, Growing(folder, f"{_name(p)}-new")).add(df, rows)
                delta[p] = Relation(df, types[p])
                upkeep.inserted += rows
        k += 1
    return {p: full(Rel(p[0], (None,) * p[1])) for p in part}
