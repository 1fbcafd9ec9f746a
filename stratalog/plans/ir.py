"""The logical program: terms, goals, rules, statements."""

from __future__ import annotations

from dataclasses import dataclass, field

from stratalog.functions.values import text_of


@dataclass(frozen=True)
class Var:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Const:
    value: object

    def __str__(self) -> str:
        return text_of(self.value)


@dataclass(frozen=True)
class Cell:
    """A list pattern ``head!tail`` that holds variables."""

    head: "Term"
    tail: "Term"

    def __str__(self) -> str:
        return f"{self.head}!{self.tail}"


Term = Var | Const | Cell


@dataclass(frozen=True)
class Rel:
    name: str
    args: tuple[Term, ...]
    negated: bool = False

    @property
    def key(self) -> tuple[str, int]:
        return self.name, len(self.args)

    def __str__(self) -> str:
        return f"{'not ' * self.negated}{self.name}({', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Compare:
    op: str
    left: Term
    right: Term
    negated: bool = False

    def __str__(self) -> str:
        return f"{'not ' * self.negated}{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class TypeTest:
    term: Term
    type: object
    negated: bool = False

    def __str__(self) -> str:
        return f"{'not ' * self.negated}{self.term} : {type_text(self.type)}"


@dataclass(frozen=True)
class Arith:
    out: Term
    left: Term
    op: str
    right: Term

    def __str__(self) -> str:
        return f"{self.out} = {self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class SetOf:
    template: Term
    goals: tuple["Goal", ...]
    result: Term

    def __str__(self) -> str:
        return f"setof({self.template}, ({', '.join(map(str, self.goals))}), {self.result})"


Goal = Rel | Compare | TypeTest | Arith | SetOf


@dataclass(frozen=True)
class Rule:
    head: Rel
    body: tuple[Goal, ...]

    def __str__(self) -> str:
        return f"{self.head} :- {', '.join(map(str, self.body))}."


@dataclass(frozen=True)
class Query:
    goals: tuple[Goal, ...]
    order: tuple[tuple[str, bool], ...] = ()  # name, descending


@dataclass(frozen=True)
class Retract:
    goals: tuple[Goal, ...]


@dataclass(frozen=True)
class Schema:
    name: str
    columns: tuple[tuple[str | None, object], ...] = field(default=())


@dataclass(frozen=True)
class Fact:
    head: Rel


def type_text(t: object) -> str:
    return f"list({type_text(t[1])})" if isinstance(t, tuple) else str(t)


def term_vars(t: Term) -> list[str]:
    if isinstance(t, Var):
        return [t.name]
    return term_vars(t.head) + term_vars(t.tail) if isinstance(t, Cell) else []


def goal_vars(g: Goal, inside: bool = True) -> list[str]:
    """Variables in the order of their first mention; those inside an aggregate only if ``inside``."""
    if isinstance(g, Rel):
        out = [v for t in g.args for v in term_vars(t)]
    elif isinstance(g, Compare):
        out = term_vars(g.left) + term_vars(g.right)
    elif isinstance(g, TypeTest):
        out = term_vars(g.term)
    elif isinstance(g, Arith):
        out = term_vars(g.out) + term_vars(g.left) + term_vars(g.right)
    else:
        out = ([v for x in g.goals for v in goal_vars(x)] + term_vars(g.template) if inside else []) + term_vars(g.result)
    return list(dict.fromkeys(out))


def has_cell(t: Term) -> bool:
    return isinstance(t, Cell)
