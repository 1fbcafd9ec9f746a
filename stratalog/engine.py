"""The engine: programs of facts, rules, queries and retractions over DataFrames."""

from __future__ import annotations

import dataclasses
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions.values import (
    Atom,
    DatalogError,
    InvalidFact,
    InvalidQuery,
    MaintenanceMismatch,
    NumericOverflow,
    NumericType,
    SchemaConflict,
    SchemaViolation,
    UndefinedView,
    UnknownVariable,
    holds,
    is_subtype,
    join_types,
    type_of,
)
from stratalog.operators.alike import by_classes, sources
from stratalog.operators.body import Bindings, Compiler, Relation, lifted, lowered, rendered, spark_type, union, widened
from stratalog.operators.fixpoint import OUTSIDE, Upkeep, closure_edge, doubled, kept, maintained, naive, reads_inside, semi_naive, shared_folder
from stratalog.operators.lists import LISTS, list_constants, seeded, universe
from stratalog.operators.pairs import paired
from stratalog.plans.policy import CostModel
from stratalog.plans.check import check_program, check_rule, ordered, reads, seed_position
from stratalog.plans.ir import Arith, Cell, Compare, Const, Fact, Goal, Query, Rel, Retract, Rule, Schema, Term, TypeTest, Var, goal_vars, term_vars
from stratalog.plans.typing import check_types
from stratalog.results import Answer
from stratalog.plans.parser import parse_goals, parse_program, parse_rule

Key = tuple[str, int]
DIRECT = ""
#: After so many rounds of maintenance a relation is written anew as one table.
COMPACT_AFTER = 8


@dataclass
class Changed:
    """The result of a retraction or a batch: whether base facts changed."""

    changed: bool


@dataclass
class State:
    """All of the database; statements replace it as a whole, so a failed one leaves no trace."""

    literal: dict[Key, frozenset] = field(default_factory=dict)
    external: dict[Key, Relation] = field(default_factory=dict)
    removed: dict[Key, Relation] = field(default_factory=dict)
    rules: tuple[Rule, ...] = ()
    schemas: dict[str, tuple] = field(default_factory=dict)
    #: Who asserts which literal facts; DIRECT stands for those that programs assert without a contributor.
    contributions: dict[str, frozenset] = field(default_factory=dict)

    def copy(self) -> "State":
        return State(dict(self.literal), dict(self.external), dict(self.removed), self.rules, dict(self.schemas), dict(self.contributions))


def head_vars(rule: Rule) -> set[str]:
    return {v for t in rule.head.args for v in term_vars(t)}


def list_functions(state: State) -> dict[Key, str]:
    """Predicates whose facts and rules are exactly length, sum, member or collectfirst, up to variable names."""
    shapes = {
        "length": parse_rule("p(H!T, N) :- p(T, M), N = M + 1."),
        "sum": parse_rule("p(H!T, N) :- p(T, M), N = M + H."),
        "collectfirst": parse_rule("p([H, K]!T, H!R) :- p(T, R)."),
    }
    out = {}
    for key in {r.head.key for r in state.rules}:
        rules = [r for r in state.rules if r.head.key == key]
        facts = state.literal.get(key, frozenset())
        if key in state.external or key[1] != 2:
            continue
        if len(rules) == 1 and facts in (frozenset({((), 0)}), frozenset({((), ())})):
            said = _shape(rules[0])
            for name, shape in shapes.items():
                if said == _shape(shape) and (name == "collectfirst") == (facts == frozenset({((), ())})):
                    out[key] = name
        elif len(rules) == 2 and not facts and {_shape(r) for r in rules} == {_shape(parse_rule("p(X, H!T) :- X = H.")), _shape(parse_rule("p(X, H!T) :- p(X, T)."))}:
            out[key] = "member"
    return out


def _shape(rule: Rule) -> str:
    """The rule with its predicate and variables named by their first use."""
    names: dict[str, str] = {}

    def term(t: Term) -> str:
        if isinstance(t, Var):
            return names.setdefault(t.name, f"V{len(names)}")
        return f"({term(t.head)}!{term(t.tail)})" if isinstance(t, Cell) else str(t)

    def goal(g: Goal) -> str:
        if isinstance(g, Rel):
            return f"{'p' if g.key == rule.head.key else g.name}({','.join(map(term, g.args))}){g.negated}"
        if isinstance(g, Arith):
            left, right = term(g.left), term(g.right)
            return f"{term(g.out)}={g.op.join(sorted([left, right]) if g.op == '+' else [left, right])}"
        if isinstance(g, Compare):
            return f"{g.op}{sorted([term(g.left), term(g.right)])}{g.negated}"
        return str(g)

    return goal(rule.head) + ":-" + ";".join(goal(g) for g in rule.body)


class Engine:
    """Facts are literals of programs or tables registered as predicates; derived predicates are plans over them.

    Non-recursive predicates stay lazy, so Catalyst sees the whole query down to the scan; recursive ones are
    computed to a fixpoint once for every state of the database.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.state = State()
        self.generation = 0
        self.policy = CostModel()
        self.upkeep = Upkeep()
        self.watchers: list[Callable[[int], None]] = []
        self._derived: dict[Key, Relation | None] = {}
        #: Recursive predicates whose inputs changed, each with the engine as it was when they were last right.
        self._stale: dict[Key, Engine] = {}
        self._age: dict[Key, int] = {}
        #: Changed base facts by generation; None where a whole table was replaced.
        self._changes: list[tuple[int, Key, Relation | None]] = []
        self._lists: frozenset = frozenset()

    # -- sources -------------------------------------------------------------------------------------------------

    def register(self, name: str, df: DataFrame, columns: list[str] | None = None) -> None:
        """A table as a predicate. Strings are atoms, integers int, doubles number, arrays lists, timestamps
        microseconds; rows with nulls are left out, as they are no facts."""
        columns = columns or df.columns
        picked, types = [], []
        for c in columns:
            col, kind = external_column(F.col(f"`{c}`"), df.schema[c].dataType)
            picked.append(col)
            types.append(kind)
        out = df.select(*[c.alias(f"c{i}") for i, c in enumerate(picked)]).na.drop()
        key, table = (name, len(columns)), Relation(out, tuple(types))
        self._check_table(key, table)
        new = self.state.copy()
        new.external[key] = table
        self._changes.append((self.generation + 1, key, None))
        self._commit(new, {key})

    # -- programs ------------------------------------------------------------------------------------------------

    def execute(self, source: str, contributor: str | None = None) -> object:
        """Run a program; the last statement's result: None, Changed, or a query's DataFrame.

        Consecutive facts are one transaction with a savepoint each: a bad one fails alone, those before it stay.
        """
        return self.execute_statements(parse_program(source), contributor)

    def execute_statements(self, statements: list, contributor: str | None = None) -> object:
        result: object = None
        facts: list[Rel] = []
        for s in [*statements, None]:
            if isinstance(s, Fact):
                facts.append(s.head)
                result = None
                continue
            if facts:
                self.add_facts(facts, contributor)
                facts = []
            if s is not None:
                result = self.run(s, contributor)
        return result

    def run(self, s: object, contributor: str | None = None) -> object:
        if isinstance(s, Fact):
            return self.add_fact(s.head, contributor)
        if isinstance(s, Rule):
            return self.add_rule(s)
        if isinstance(s, Schema):
            return self.declare_schema(s)
        if isinstance(s, Retract):
            return self.retract(s.goals)
        return self.query(s.goals, s.order)

    def add_fact(self, head: Rel, contributor: str | None = None) -> None:
        self.add_facts([head], contributor)

    def add_facts(self, heads: list[Rel], contributor: str | None = None) -> None:
        """Assert ground facts in one commit; the first that is none ends it, with those before it asserted."""
        added: dict[Key, set] = {}
        wrong: DatalogError | None = None
        for head in heads:
            try:
                if not all(isinstance(t, Const) for t in head.args):
                    raise InvalidFact(str(head))
                row = tuple(t.value for t in head.args)
                self._check_fact(head.key, row)
                added.setdefault(head.key, set()).add(row)
            except DatalogError as error:
                wrong = error
                break
        if added:
            self._assert(added, contributor or DIRECT)
        if wrong is not None:
            raise wrong

    def _assert(self, added: dict[Key, set], contributor: str) -> None:
        new = self.state.copy()
        changed = set()
        for key, rows in added.items():
            fresh = rows - new.literal.get(key, frozenset())
            if fresh:
                changed.add(key)
                new.literal[key] = new.literal.get(key, frozenset()) | fresh
                self._note(key, list(fresh))
            if key in new.removed:
                # asserted again, also where a deletion had taken it away
                types = tuple(_columns_type([r[i] for r in rows]) for i in range(key[1]))
                back = Relation(_literal_frame(self.spark, frozenset(rows), types), types)
                types = tuple(map(join_types, new.removed[key].types, types))
                new.removed[key] = Relation(widened(new.removed[key], types).join(widened(back, types), [f"c{i}" for i in range(key[1])], "left_anti") if key[1] else new.removed[key].df.where(F.lit(False)), types)
                if not fresh:
                    changed.add(key)
                    self._note(key, list(rows))
        new.contributions[contributor] = new.contributions.get(contributor, frozenset()) | {(k, r) for k, rows in added.items() for r in rows}
        if changed:
            self._commit(new, changed)
        else:
            self.state = new

    def _note(self, key: Key, rows: list[tuple] | Relation) -> None:
        """Remember facts that a commit about to come inserts or deletes."""
        self._changes.append((self.generation + 1, key, self._batch(key, rows)))

    def add_rule(self, rule: Rule | str) -> None:
        rule = check_rule(parse_rule(rule) if isinstance(rule, str) else rule)
        new = self.state.copy()
        if rule not in new.rules:
            new.rules += (rule,)
        check_program(list(new.rules))
        check_types(rule.body, new.schemas, rule.head)
        self._commit(new, None)

    def admitted(self, rule: Rule, others: list[Rule]) -> Rule:
        """A rule that could stand beside the engine's own and these; an error if it can't."""
        rule = check_rule(rule)
        check_program([*self.state.rules, *others, rule])
        check_types(rule.body, self.state.schemas, rule.head)
        return rule

    def replace_rules(self, rules: list[Rule]) -> None:
        """All rules at once."""
        check_program(rules)
        new = self.state.copy()
        new.rules = tuple(rules)
        self._commit(new, None)

    def declare_schema(self, s: Schema) -> None:
        names = [n for n, _ in s.columns if n]
        if len(set(names)) != len(names):
            raise DatalogError("InvalidTerm: a column name repeats")
        if s.name in self.state.schemas:
            if self.state.schemas[s.name] != s.columns:
                raise SchemaConflict(s.name)
            return
        new = self.state.copy()
        new.schemas[s.name] = s.columns
        for (name, arity), rows in new.literal.items():
            for row in rows if name == s.name else ():
                self._check_fact((name, arity), row, new.schemas)
        for (name, arity), table in new.external.items():
            if name == s.name:
                self._check_table((name, arity), table, new.schemas)
        for rule in new.rules:
            check_types(rule.body, new.schemas, rule.head)
        self._commit(new, set())

    def _check_fact(self, key: Key, row: tuple, schemas: dict | None = None) -> None:
        columns = (self.state.schemas if schemas is None else schemas).get(key[0])
        if columns is not None and (len(columns) != key[1] or not all(holds(v, t) for v, (_, t) in zip(row, columns))):
            raise SchemaViolation(f"{key[0]}/{key[1]}")

    def _commit(self, new: State, changed: set[Key] | None) -> None:
        """The new state, with what doesn't depend on the changed predicates kept (None: the rules changed, nothing is)."""
        before = self._as_is()
        self.state = new
        self.generation += 1
        if changed is None:
            self._derived, self._stale, self._age, self._changes = {}, {}, {}, []
        else:
            for key in self.dependents(changed):
                had = self._derived.pop(key, None)
                if had is not None and key in self._age and key not in self._stale:
                    self._stale[key] = before
        for watcher in self.watchers:
            watcher(self.generation)

    def _as_is(self) -> "Engine":
        """A copy that later commits leave alone; it shares what is derived."""
        out = Engine.__new__(Engine)
        out.__dict__.update(self.__dict__)
        out._derived, out._stale, out._age = dict(self._derived), dict(self._stale), dict(self._age)
        out.watchers = []
        return out

    def dependents(self, changed: set[Key]) -> set[Key]:
        """Derived predicates that read one of these, directly or not; walkers of lists read all facts."""
        out = set()
        heads = {r.head.key for r in self.state.rules}
        into: dict[Key, set[Key]] = {}
        for r in self.state.rules:
            for p, _ in reads(r.body):
                into.setdefault(p, set()).add(r.head.key)
        todo = [*changed, LISTS]
        into[LISTS] = {r.head.key for r in self.state.rules if seeded(r) is not r}
        while todo:
            p = todo.pop()
            if p in out:
                continue
            if p in heads or p == LISTS:
                out.add(p)
            todo += [q for q in into.get(p, ()) if q not in out]
        return out

    def _check_table(self, key: Key, table: Relation, schemas: dict | None = None) -> None:
        """A whole table against its schema: by its column types, and by its values where those don't tell."""
        columns = (self.state.schemas if schemas is None else schemas).get(key[0])
        if columns is None:
            return
        if len(columns) != key[1]:
            raise SchemaViolation(f"{key[0]}/{key[1]}")
        compiler = self._compiler(lambda g: None, set(), False)
        wrong = F.lit(False)
        for i, (mine, (_, kind)) in enumerate(zip(table.types, columns)):
            if not is_subtype(mine, kind):
                wrong = wrong | ~compiler.has_type(F.col(f"c{i}"), mine, kind)
        if key[1] and not table.df.where(wrong).isEmpty():
            raise SchemaViolation(f"{key[0]}/{key[1]}")

    # -- relations -----------------------------------------------------------------------------------------------

    def base(self, key: Key) -> Relation | None:
        """Asserted facts: literals of programs and registered tables, each once."""
        parts = []
        rows = self.state.literal.get(key)
        if rows:
            types = tuple(_columns_type([r[i] for r in rows]) for i in range(key[1]))
            columns = self.state.schemas.get(key[0])
            if columns is not None:
                types = tuple(join_types(t, d) if is_subtype(t, d) and d not in ("any", ("list", "any")) else t for t, (_, d) in zip(types, columns))
            parts.append(Relation(_literal_frame(self.spark, rows, types), types))
        if key in self.state.external:
            parts.append(self.state.external[key])
        if not parts:
            return None
        out = parts[0] if len(parts) == 1 else union(parts)
        gone = self.state.removed.get(key)
        if gone is not None:
            types = tuple(map(join_types, out.types, gone.types))
            out = Relation(widened(out, types).join(widened(gone, types), [f"c{i}" for i in range(key[1])], "left_anti") if key[1] else out.df.where(F.lit(False)), types)
        return out

    def relation(self, key: Key) -> Relation | None:
        """Asserted and derived facts together."""
        if key == LISTS:
            if key not in self._derived:
                self._derived[key] = self._universe()
            return self._derived[key]
        heads = {r.head.key for r in self.state.rules}
        if key not in heads:
            return self.base(key)
        if key not in self._derived:
            self._derive(key)
        return self._derived[key]

    def _universe(self) -> Relation | None:
        """All lists of the facts, of the rules and of the question asked; of derived facts, those of predicates that neither recur nor walk lists."""
        walkers = self.dependents(set())
        parts = check_program(list(self.state.rules))
        simple = [p[0] for p in parts if len(p) == 1 and p[0] not in walkers and not any(q == p[0] for r in self.state.rules if r.head.key == p[0] for q, _ in reads(r.body))]
        keys = [*{*self.state.literal, *self.state.external}, *simple]
        relations = [r for r in map(self.relation if not walkers else lambda k: self.relation(k) if k not in walkers else self.base(k), keys) if r is not None]
        values = set(self._lists)
        for r in self.state.rules:
            values |= list_constants((r.head, *r.body))
        made = universe(self.spark, relations, values)
        if made is None:
            return None
        df, _ = kept(made.df, shared_folder(self.spark), "lists")
        return Relation(df, made.types)

    def component(self, key: Key) -> tuple[list[Key], list[Rule]]:
        """The predicates that recur with this one, and their rules, with the lists they walk made explicit."""
        part = next(p for p in check_program(list(self.state.rules)) if key in p)
        return part, [seeded(r) for r in self.state.rules if r.head.key in part]

    def _derive(self, key: Key) -> None:
        part, rules = self.component(key)
        base = {p: r for p in part if (r := self.base(p)) is not None}
        recursive = any(p in part for r in rules for p, _ in reads(r.body))
        if not recursive:
            found = [base[key]] if key in base else []
            compiler = self._compiler(lambda g: None, set(), False)
            if len(rules) == 1 and not found and (pairs := paired(compiler, rules[0])) is not None:
                self._derived[key] = pairs
                return
            for r in rules:
                b = compiler.body(r.body, needed=head_vars(r))
                if b is not None:
                    found.append(compiler.head(b, r.head))
            if not found:
                self._derived[key] = None
                return
            out = union(found)
            self._derived[key] = Relation(out.df.distinct(), out.types)
            return
        old = self._stale.pop(key, None)
        began = time.monotonic()
        made = self._maintained(old, part, rules, base) if old is not None else None
        if made is not None:
            self.upkeep.maintained += 1
            self.policy.saw("maintain", time.monotonic() - began)
        else:
            made = self._rebuilt(part, rules, base)
            self.upkeep.rebuilt += 1
            self.policy.saw("rebuild", time.monotonic() - began)
        for p in part:
            self._stale.pop(p, None)
            self._derived[p] = made.get(p)
            self._age[p] = self._age.get(p, 0) + 1 if old is not None else 0

    def _rebuilt(self, part: list[Key], rules: list[Rule], base: dict[Key, Relation]) -> dict[Key, Relation]:
        folder = shared_folder(self.spark)
        edge = closure_edge(rules, part)
        if edge is not None and not base:
            r = self.relation(edge.key)
            return {} if r is None else {part[0]: doubled(r, folder)}
        compiler_for = lambda lookup, mine: self._compiler(lookup, mine, False)
        came = sources(rules, part, {LISTS, *list_functions(self.state)}) if not base else None
        made = by_classes(compiler_for, rules, part, came, self.relation, folder) if came else None
        return semi_naive(compiler_for, rules, part, base, folder) if made is None else made

    # -- maintenance ---------------------------------------------------------------------------------------------

    def _maintained(self, old: "Engine", part: list[Key], rules: list[Rule], base: dict[Key, Relation]) -> dict[Key, Relation] | None:
        """A recursive component brought up to date from what it was in ``old``; None where it has to be rebuilt."""
        before = {p: old._derived.get(p) for p in part}
        if any(r is None for r in before.values()) or not self.policy.maintain():
            return None
        inside: set[Key] = set()
        for r in rules:
            reads_inside(r.body, inside)
        touched = {k for g, k, _ in self._changes if g > old.generation}
        changed = touched | self.dependents(touched)
        inserted: dict[Key, Relation] = {}
        deleted: dict[Key, Relation] = {}
        folder = shared_folder(self.spark)
        for p in {q for r in rules for q, _ in reads(r.body)} | set(part):
            if p not in changed or p in part and p not in touched:
                continue
            if p in inside or p == LISTS:
                return None
            got = self._difference(old, p, folder, of_base=p in part)
            if got is None:
                return None
            for into, r in zip((inserted, deleted), got):
                if r is not None:
                    into[p] = r
        made = maintained(lambda lookup, mine: self._compiler(lookup, mine, False), lambda lookup, mine: old._compiler(lookup, mine, False), rules, part, before, base, inserted, deleted, folder, self.upkeep)
        if made is None:
            return None
        for p in part:
            if self._age.get(p, 0) >= COMPACT_AFTER:
                made[p] = Relation(kept(made[p].df, folder, f"{p[0]}-{p[1]}-compact")[0], made[p].types)
                self._age[p] = -1
        return made

    def _difference(self, old: "Engine", key: Key, folder: str, of_base: bool = False) -> tuple[Relation | None, Relation | None] | None:
        """What a predicate's facts gained and lost since ``old``, from the facts that can have moved, so that no table is compared as a whole."""
        moved = self._moved(old, key, folder, of_base)
        if moved is None:
            return None
        names = [f"c{i}" for i in range(key[1])]
        if not names:
            return None
        now, then = (e.base(key) if of_base else e._among(key, moved) for e in (self, old))
        sides = []
        for mine, other in ((now, then), (then, now)):
            if mine is None:
                sides.append(None)
                continue
            types = tuple(map(join_types, moved.types, mine.types))
            if other is not None:
                types = tuple(map(join_types, types, other.types))
            df = widened(moved, types).distinct()
            df = df.join(widened(mine, types), names, "left_semi")
            if other is not None:
                df = df.join(widened(other, types), names, "left_anti")
            sides.append(Relation(df, types))
        out = []
        for side, r in zip(("in", "out"), sides):
            df, rows = kept(r.df, folder, f"{key[0]}-{key[1]}-{side}") if r is not None else (None, 0)
            out.append(Relation(df, r.types) if rows else None)
        return tuple(out)

    def _moved(self, old: "Engine", key: Key, folder: str, of_base: bool) -> Relation | None:
        """Facts of a predicate that a change since ``old`` can have moved; None where only a full comparison tells."""
        found: list[Relation] = []
        for generation, k, rows in self._changes:
            if k == key and generation > old.generation:
                if rows is None:
                    return None
                found.append(rows)
        rules = [] if of_base else [r for r in self.state.rules if r.head.key == key]
        if rules:
            touched = {k for g, k, _ in self._changes if g > old.generation}
            changed = touched | self.dependents(touched)
            inside: set[Key] = set()
            for r in rules:
                reads_inside(r.body, inside)
            if inside & changed or any(seeded(r) is not r or q == key for r in rules for q, _ in reads(r.body)):
                return None
            for r in rules:
                for g in r.body:
                    if isinstance(g, Rel) and g.key in changed:
                        below = self._moved(old, g.key, folder, False)
                        if below is None:
                            return None
                        for host in (self, old):
                            compiler = host._compiler(lambda x, g=g, below=below, host=host: below if x is g else host.relation(x.key), {g.key}, False)
                            b = compiler.body(r.body, needed=head_vars(r))
                            if b is not None:
                                found.append(compiler.head(b, r.head))
        if not found:
            return None
        out = union(found)
        df, _ = kept(out.df.distinct(), folder, f"{key[0]}-{key[1]}-moved-{uuid.uuid4().hex[:6]}")
        return Relation(df, out.types)

    def _among(self, key: Key, asked: Relation) -> Relation | None:
        """Those of the asked facts that hold, with rules evaluated from them outwards."""
        found = []
        base = self.base(key)
        names = [f"c{i}" for i in range(key[1])]
        if base is not None:
            types = tuple(map(join_types, base.types, asked.types))
            found.append(Relation(widened(asked, types).join(widened(base, types), names, "left_semi"), types))
        for r in self.state.rules:
            if r.head.key == key:
                goal = Rel(f"$asked {key[0]}", r.head.args)
                compiler = self._compiler(lambda g: asked, {goal.key}, False)
                b = compiler.body((goal, *r.body), needed=head_vars(r))
                if b is not None:
                    found.append(compiler.head(b, r.head))
        return union(found) if found else None

    def _compiler(self, lookup, mine: set, strict: bool) -> Compiler:
        def found(g: Rel) -> Relation | None:
            got = lookup(g) if g.key in mine else OUTSIDE
            return self.relation(g.key) if got is OUTSIDE else got

        return Compiler(self.spark, found, list_functions(self.state), strict)

    # -- queries -------------------------------------------------------------------------------------------------

    def bindings(self, goals: tuple[Goal, ...] | str) -> tuple[Bindings | None, list[str]]:
        goals = parse_goals(goals) if isinstance(goals, str) else goals
        names = list(dict.fromkeys(v for g in goals for v in goal_vars(g, inside=False)))
        check_types(goals, self.state.schemas)
        compiler = self._with_lists(goals)._compiler(lambda g: None, set(), True)
        return compiler.body(ordered(goals, set(), InvalidQuery)), names

    def _with_lists(self, goals: tuple[Goal, ...]) -> "Engine":
        """An engine to answer from, whose walkers of lists also walk those written in the question."""
        new = frozenset(list_constants(goals)) - self._lists
        if not new or not self.dependents(set()) - {LISTS}:
            return self
        out = self._as_is()
        out._lists = self._lists | new
        for key in out.dependents(set()):
            out._derived.pop(key, None)
            out._stale.pop(key, None)
        return out

    def query(self, goals: tuple[Goal, ...] | str, order: tuple[tuple[str, bool], ...] = (), sort: bool = True) -> DataFrame:
        """One column a variable, in the order of first mention, rows in canonical order after the keys of ``order``.

        Lists and mixed values come as canonical text. A query without variables has one column and a row if it holds.
        """
        goals = parse_goals(goals) if isinstance(goals, str) else goals
        b, names = self.bindings(goals)
        for k, _ in order:
            if k not in names:
                raise UnknownVariable(k)
        if b is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names or ["yes"]]))
        if not names:
            return b.df.limit(1).select(F.lit(True).alias("yes"))
        df = b.df.select(*[F.col(b.env[n][0]) for n in names])
        if not self._unique(goals):
            df = df.distinct()
        if sort:
            keys = [F.col(b.env[k][0]).desc() if down else F.col(b.env[k][0]).asc() for k, down in order]
            df = df.orderBy(*keys, *[F.col(b.env[n][0]) for n in names if n not in {k for k, _ in order}])
        return df.select(*[rendered(F.col(b.env[n][0]), b.env[n][1]).alias(n) for n in names])

    def _unique(self, goals: tuple[Goal, ...]) -> bool:
        """Whether answers are the rows of one predicate, each known to be there once."""
        g = goals[0]
        if len(goals) != 1 or not isinstance(g, Rel) or g.negated or not all(isinstance(t, Var) for t in g.args) or len(set(g.args)) != len(g.args):
            return False
        r = self._derived.get(g.key)
        return r is not None and r.unique

    def answers(self, goals: tuple[Goal, ...] | str, order: tuple[tuple[str, bool], ...] = ()) -> list[tuple]:
        """The rows of a query, with errors of evaluation under their names."""
        try:
            return [tuple(r) for r in self.query(goals, order).collect()]
        except DatalogError:
            raise
        except Exception as error:
            if "NumericType" in str(error):
                raise NumericType(str(goals)) from error
            if "OVERFLOW" in str(error):
                raise NumericOverflow(str(goals)) from error
            raise

    def results(self, goals: tuple[Goal, ...] | str, order: tuple[tuple[str, bool], ...] = ()) -> list[Answer]:
        """Answers with typed accessors, in the order of ``query``."""
        b, names = self.bindings(goals)
        for k, _ in order:
            if k not in names:
                raise UnknownVariable(k)
        if b is None:
            return []
        if not names:
            return [Answer({})] if b.df.limit(1).count() else []
        keys = [F.col(b.env[k][0]).desc() if down else F.col(b.env[k][0]).asc() for k, down in order]
        rows = b.df.select(*[F.col(b.env[n][0]) for n in names]).distinct().orderBy(*keys, *[F.col(b.env[n][0]) for n in names]).collect()
        return [Answer({n: lifted(v, b.env[n][1]) for n, v in zip(names, r)}) for r in rows]

    def explain_query(self, goals: tuple[Goal, ...] | str) -> str:
        """The goals in the order they are evaluated, with how each is, and Spark's plan."""
        goals = parse_goals(goals) if isinstance(goals, str) else goals
        lines = []
        for g in ordered(goals, set(), InvalidQuery):
            how = ("anti-join" if g.negated else "join") if isinstance(g, Rel) else "setof aggregate" if not isinstance(g, (Compare, TypeTest, Arith)) else "filter"
            lines.append(f"{g}  {how}")
        b, _ = self.bindings(goals)
        if b is not None:
            lines.append(b.df._jdf.queryExecution().simpleString())
        return "\n".join(lines)

    # -- changes -------------------------------------------------------------------------------------------------

    def retract(self, goals: tuple[Goal, ...] | str) -> Changed:
        """Delete every base fact that a positive goal matches under any answer; derived facts can't be retracted."""
        goals = parse_goals(goals) if isinstance(goals, str) else goals
        b, _ = self.bindings(goals)
        if b is None:
            return Changed(False)
        compiler = self._compiler(lambda g: None, set(), True)
        deletions: dict[Key, Relation] = {}
        for g in goals:
            if isinstance(g, Rel) and not g.negated and self.base(g.key) is not None:
                hit = compiler.head(b, g)
                deletions[g.key] = union([deletions[g.key], hit]) if g.key in deletions else hit
        return self.apply_changes({}, deletions)

    def apply_changes(self, insertions: dict[Key, Relation | list[tuple]], deletions: dict[Key, Relation | list[tuple]], contributor: str = DIRECT) -> Changed:
        """One atomic batch, deletions first; set semantics. Batches are DataFrames or lists of rows.

        Deletions are kept as relations that base facts are anti-joined with, insertions as further base facts, so a
        batch costs no rewriting of tables. Recursive predicates that read a changed one are maintained when asked for.
        """
        new, changed = self.state.copy(), set()
        noted: list[tuple[Key, object]] = []
        for key, batch in deletions.items():
            now, gone = self.base(key), self._batch(key, batch)
            if now is None or gone is None:
                continue
            types = tuple(map(join_types, now.types, gone.types))
            names = [f"c{i}" for i in range(key[1])]
            mine = new.literal.get(key, frozenset())
            if not names:
                there = mine
            elif isinstance(batch, list):
                there = mine & frozenset(map(tuple, batch))
            elif mine:
                # no more rows than the literals that the driver holds anyway
                kinds = tuple(_columns_type([r[i] for r in mine]) for i in range(key[1]))
                wide = tuple(map(join_types, kinds, gone.types))
                found = widened(Relation(_literal_frame(self.spark, mine, kinds), kinds), wide).join(widened(gone, wide), names, "left_semi").collect()
                there = frozenset(tuple(lifted(v, t) for v, t in zip(r, wide)) for r in found)
            else:
                there = frozenset()
            if there:
                new.literal[key] = mine - there
                noted.append((key, list(there)))
                changed.add(key)
                lost = {(key, r) for r in there}
                for who, facts in new.contributions.items():
                    new.contributions[who] = facts - lost
            if key in new.external:
                hit, rows = kept(widened(now, types).join(widened(gone, types), names, "left_semi").distinct(), shared_folder(self.spark), "deleted")
                if rows:
                    held = Relation(hit, types)
                    new.removed[key] = union([new.removed[key], held]) if key in new.removed else held
                    noted.append((key, held))
                    changed.add(key)
        for key, batch in insertions.items():
            more = self._batch(key, batch)
            if more is None:
                continue
            if isinstance(batch, list):
                for row in batch:
                    self._check_fact(key, tuple(row))
            else:
                self._check_table(key, more)
            old, self.state = self.state, new
            now = self.base(key)
            self.state = old
            names = [f"c{i}" for i in range(key[1])]
            fresh = more
            if now is not None and names:
                types = tuple(map(join_types, now.types, more.types))
                df, rows = kept(widened(more, types).distinct().join(widened(now, types), names, "left_anti"), shared_folder(self.spark), "inserted")
                fresh = Relation(df, types) if rows else None
            elif now is not None:
                fresh = None
            if fresh is not None:
                changed.add(key)
                noted.append((key, fresh))
            if key in new.removed:
                types = tuple(map(join_types, new.removed[key].types, more.types))
                new.removed[key] = Relation(widened(new.removed[key], types).join(widened(more, types), names, "left_anti") if names else new.removed[key].df.where(F.lit(False)), types)
            if isinstance(batch, list):
                rows = frozenset(map(tuple, batch))
                new.literal[key] = new.literal.get(key, frozenset()) | rows
                new.contributions[contributor] = new.contributions.get(contributor, frozenset()) | {(key, r) for r in rows}
            elif fresh is not None:
                both = union([new.external[key], fresh]) if key in new.external else fresh
                new.external[key] = Relation(both.df, both.types)
        if changed:
            for key, rows in noted:
                self._changes.append((self.generation + 1, key, self._batch(key, rows)))
            self._commit(new, changed)
        else:
            self.state = new
        return Changed(bool(changed))

    def _batch(self, key: Key, batch: Relation | list[tuple]) -> Relation | None:
        if isinstance(batch, Relation):
            return batch
        if not batch:
            return None
        types = tuple(_columns_type([r[i] for r in batch]) for i in range(key[1]))
        return Relation(_literal_frame(self.spark, frozenset(map(tuple, batch)), types), types)

    def set_contribution(self, contributor: str, facts: list[tuple[Key, tuple]]) -> Changed:
        """Replace all that one contributor asserts; a fact stays while anyone else asserts it, a program without a contributor too."""
        before, after = self.state.contributions.get(contributor, frozenset()), frozenset((k, tuple(r)) for k, r in facts)
        others = frozenset().union(*[f for who, f in self.state.contributions.items() if who != contributor])
        deletions: dict[Key, list] = {}
        insertions: dict[Key, list] = {}
        for k, r in (before - after) - others:
            deletions.setdefault(k, []).append(r)
        for k, r in after - before:
            insertions.setdefault(k, []).append(r)
        changed = self.apply_changes(insertions, deletions, contributor)
        state = self.state.copy()
        state.contributions[contributor] = after
        self.state = state
        return changed

    def verify(self) -> None:
        """Compare every derived predicate, as maintained, with one rebuilt from nothing by naive rounds."""
        fresh = self._as_is()
        fresh._derived, fresh._stale, fresh._age = {}, {}, {}
        fresh._rebuilt = lambda part, rules, base: naive(lambda lookup, mine: fresh._compiler(lookup, mine, False), rules, part, base, shared_folder(self.spark))
        for key in sorted({r.head.key for r in self.state.rules} - set(list_functions(self.state))):
            a, b = self.relation(key), fresh.relation(key)
            if (a is None) != (b is None):
                raise MaintenanceMismatch(str(key))
            if a is not None:
                types = tuple(map(join_types, a.types, b.types))
                x, y = widened(a, types), widened(b, types)
                if not (x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()):
                    raise MaintenanceMismatch(str(key))
        self.upkeep.verified += 1

    def maintenance_stats(self) -> dict[str, object]:
        """What maintenance did so far, and what its cost model thinks."""
        return dataclasses.asdict(self.upkeep) | dataclasses.asdict(self.policy) | {"generation": self.generation, "stale": len(self._stale), "materialized": len(self._age)}

    def watch(self, callback: Callable[[int], None]) -> Callable[[], None]:
        """Call back with the generation, now and after each change; returns what ends it."""
        self.watchers.append(callback)
        callback(self.generation)
        return lambda: self.watchers.remove(callback)

    # -- introspection -------------------------------------------------------------------------------------------

    def base_facts(self, name: str, arity: int) -> DataFrame | None:
        """Asserted facts, columns named 1, 2, ..."""
        r = self.base((name, arity))
        return None if r is None else r.df.select(*[rendered(F.col(f"c{i}"), t).alias(str(i + 1)) for i, t in enumerate(r.types)]).distinct()

    def predicates(self) -> list[Key]:
        return sorted({*self.state.literal, *self.state.external, *(r.head.key for r in self.state.rules)})

    def count_facts(self, name: str, arity: int) -> int:
        r = self.relation((name, arity))
        return 0 if r is None else r.df.distinct().count()

    def schema_columns(self, name: str) -> tuple | None:
        return self.state.schemas.get(name)

    def rows(self, name: str, arity: int, offset: int = 0, limit: int = 100, by: list[tuple[int, bool]] | None = None) -> DataFrame:
        """One page of a predicate: sorted, with an origin column (base or derived)."""
        r, base = self.relation((name, arity)), self.base((name, arity))
        if r is None:
            raise UndefinedView(f"{name}/{arity}")
        names = [f"c{i}" for i in range(arity)]
        df = r.df.distinct()
        if base is None:
            df = df.withColumn("origin", F.lit("derived"))
        else:
            mark = widened(base, r.types).distinct().withColumn("_b", F.lit("base"))
            df = df.join(mark, names, "left").withColumn("origin", F.coalesce("_b", F.lit("derived"))).drop("_b")
        keys = [F.col(f"c{p}").desc() if down else F.col(f"c{p}").asc() for p, down in by or []]
        page = df.orderBy(*keys, *names).offset(offset).limit(limit)
        return page.select(*[rendered(F.col(n), t).alias(str(i + 1)) for i, (n, t) in enumerate(zip(names, r.types))], "origin")

    def materialize(self) -> None:
        for key in self.predicates():
            if key not in list_functions(self.state):
                self.relation(key)

    def rebuild(self) -> None:
        self._derived, self._stale, self._age, self._changes = {}, {}, {}, []
        self.materialize()


def _columns_type(values: list) -> object:
    t: object = "never"
    for v in values:
        t = join_types(t, type_of(v))
    return t


def _literal_frame(spark: SparkSession, rows: frozenset, types: tuple) -> DataFrame:
    if not types:
        return spark.range(1).select(F.lit(1).alias("c_"))
    schema = T.StructType([T.StructField(f"c{i}", spark_type(t)) for i, t in enumerate(types)])
    return spark.createDataFrame([tuple(lowered(v, t) for v, t in zip(r, types)) for r in sorted(rows, key=repr)], schema)


def external_column(c, kind: T.DataType) -> tuple:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return c.cast("long"), "int"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        wide = c.cast("double")
        return F.when(~F.isnan(wide) & (F.abs(wide) != F.lit(float("inf"))), wide), "number"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")), "int"
    if isinstance(kind, T.ArrayType):
        inner = external_column(F.lit(None).cast(kind.elementType), kind.elementType)[1]
        return c.cast(T.ArrayType(spark_type(inner))), ("list", inner)
    return c.cast("string"), "atom"


__all__ = ["Atom", "Changed", "Engine", "seed_position"]
