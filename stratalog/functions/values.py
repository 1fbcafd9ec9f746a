"""The value domain: exact integers, finite floats, atoms, lists and pairs; their order, text and sortable keys."""

from __future__ import annotations

import math
import re
import struct
from dataclasses import dataclass


class DatalogError(Exception):
    """Base of all errors; ``code`` is the error's name."""

    def __init__(self, message: str = ""):
        super().__init__(f"{type(self).__name__}: {message}" if message else type(self).__name__)

    @property
    def code(self) -> str:
        return type(self).__name__


def _error(name: str, what: str) -> type[DatalogError]:
    return type(name, (DatalogError,), {"__doc__": what, "__module__": __name__})


InvalidSyntax = _error("InvalidSyntax", "The text is no program.")
InvalidFact = _error("InvalidFact", "A fact that is not ground, or no relation.")
InvalidRule = _error("InvalidRule", "A rule that is not safe.")
InvalidQuery = _error("InvalidQuery", "A query that is not safe.")
InvalidTerm = _error("InvalidTerm", "A malformed descriptor.")
NotStratified = _error("NotStratified", "Negation or aggregation on a cycle.")
NotAdmissible = _error("NotAdmissible", "Recursion that could grow for ever.")
IllTyped = _error("IllTyped", "Static types rule it out.")
SchemaViolation = _error("SchemaViolation", "A fact outside its declared schema.")
SchemaConflict = _error("SchemaConflict", "A second, different schema.")
NumericType = _error("NumericType", "A number was needed.")
NumericOverflow = _error("NumericOverflow", "A number outside its range.")
UnknownVariable = _error("UnknownVariable", "No such variable among the answers.")
UndefinedView = _error("UndefinedView", "No single rule defines the view.")
MaintenanceMismatch = _error("MaintenanceMismatch", "Maintained and rebuilt closures differ.")
UnboundVariable = _error("UnboundVariable", "A variable without a value where one is needed.")
UnknownOperator = _error("UnknownOperator", "No such operator.")
TypeMismatch = _error("TypeMismatch", "A value of another type was asked for.")
AmbiguousViewName = _error("AmbiguousViewName", "A view's name that means two things.")
StaleViewDefinition = _error("StaleViewDefinition", "The rules changed after the view was published.")
StalePlan = _error("StalePlan", "The catalog or the rules changed after the plan was made.")
PlanNotExecutable = _error("PlanNotExecutable", "The fold refused the question, so it has no plan.")
Unsupported = _error("Unsupported", "Outside what this engine evaluates.")


class Atom(str):
    """A byte string that names something."""

    __slots__ = ()

    def __repr__(self) -> str:
        return f"Atom({str(self)!r})"


@dataclass(frozen=True)
class Pair:
    """A cons cell whose tail is no list."""

    head: object
    tail: object


def cons(head: object, tail: object) -> object:
    return (head, *tail) if isinstance(tail, tuple) else Pair(head, tail)


def canonical_number(x: int | float) -> int | float:
    """Integral floats within 64 bits become integers; NaN and infinities are errors."""
    if isinstance(x, float):
        if math.isnan(x):
            raise NumericType("not a number")
        if math.isinf(x):
            raise NumericOverflow("infinite")
        if x == int(x) and -(2**63) <= x < 2**63:
            return int(x)
    elif not -(2**63) <= x < 2**63:
        raise NumericOverflow(str(x))
    return x


def parse_number(token: str) -> int | float:
    if re.fullmatch(r"[+-]?\d+", token):
        return canonical_number(int(token))
    if re.fullmatch(r"[+-]?\d+(\.\d+)?([eE][+-]?\d+)?", token):
        return canonical_number(float(token))
    raise InvalidSyntax(f"no number: {token}")


def number_text(x: int | float) -> str:
    """Shortest text that reads back; plain decimals from 1e-3 up to 1e16."""
    if isinstance(x, int):
        return str(x)
    if 1e-3 <= abs(x) < 1e16:
        s = repr(x)
        return format(x, "f").rstrip("0") if "e" in s else s
    mantissa, _, exponent = repr(x).partition("e")
    if not exponent:
        mantissa, _, exponent = format(x, ".17e").partition("e")
        for digits in range(17):
            short = format(x, f".{digits}e")
            if float(short) == x:
                mantissa, _, exponent = short.partition("e")
                break
    return f"{mantissa}e{int(exponent)}"


_BARE = re.compile(r"[a-z_][A-Za-z0-9_]*\Z")


def atom_text(a: str) -> str:
    if _BARE.match(a):
        return str(a)
    said = a.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r")
    return f"'{said}'"


def text_of(v: object) -> str:
    if isinstance(v, Atom):
        return atom_text(v)
    if isinstance(v, tuple):
        return "[" + ", ".join(map(text_of, v)) + "]"
    if isinstance(v, Pair):
        return f"cons({text_of(v.head)}, {text_of(v.tail)})"
    return number_text(v)


# Sortable keys: one tag byte, then a prefix-free body; byte order is the canonical order
# numbers (by exact value) < atoms (by bytes) < [] < pairs (head, then tail). A number is its nearest double and what the
# exact integer has beyond it, each as eight bytes that sort as the number does.
NUMBER, ATOM, NIL, CONS = 0x10, 0x20, 0x30, 0x40


def split_number(x: int | float) -> tuple[float, int]:
    """The nearest double, and the rest of an integer that no double holds."""
    near = float(x)
    return (near, x - int(near)) if isinstance(x, int) else (near + 0.0, 0)


def joined_number(near: float, rest: int) -> int | float:
    if near == math.floor(near) and -(2**63) <= int(near) + rest < 2**63:
        return int(near) + rest
    return near


def _number_key(x: int | float) -> bytes:
    near, rest = split_number(x)
    bits = int.from_bytes(struct.pack(">d", near if near else 0.0), "big")
    bits = bits ^ ((1 << 64) - 1) if bits >> 63 else bits | 1 << 63
    return struct.pack(">QQ", bits, rest + (1 << 63))


def key_of(v: object) -> bytes:
    if isinstance(v, Atom):
        return bytes([ATOM]) + v.encode().replace(b"\0", b"\0\1") + b"\0\0"
    if isinstance(v, tuple):
        return b"".join(bytes([CONS]) + key_of(x) for x in v) + bytes([NIL])
    if isinstance(v, Pair):
        return bytes([CONS]) + key_of(v.head) + key_of(v.tail)
    return bytes([NUMBER]) + _number_key(canonical_number(v))


def _read(key: bytes, at: int) -> tuple[object, int]:
    tag = key[at]
    if tag == NIL:
        return (), at + 1
    if tag == ATOM:
        out, at = bytearray(), at + 1
        while True:
            if key[at] == 0:
                if key[at + 1] == 0:
                    return Atom(out.decode()), at + 2
                out.append(0)
                at += 2
            else:
                out.append(key[at])
                at += 1
    if tag == CONS:
        heads, at = [], at
        while key[at] == CONS:
            head, at = _read(key, at + 1)
            heads.append(head)
        tail, at = _read(key, at)
        for h in reversed(heads):
            tail = cons(h, tail)
        return tail, at
    bits, rest = struct.unpack_from(">QQ", key, at + 1)
    bits = bits ^ 1 << 63 if bits >> 63 else bits ^ ((1 << 64) - 1)
    return joined_number(struct.unpack(">d", bits.to_bytes(8, "big"))[0], rest - (1 << 63)), at + 17


def value_of(key: bytes) -> object:
    return _read(key, 0)[0]


# Types: atom, int, number, any, never, and ("list", T). Columns have besides "real": integers and other numbers together,
# exactly; a column of type number holds doubles only.
NUMERIC = ("int", "number", "real")


def list_of(t: object) -> tuple:
    return ("list", t)


def type_of(v: object) -> object:
    if isinstance(v, Atom):
        return "atom"
    if isinstance(v, tuple):
        t: object = "never"
        for x in v:
            t = join_types(t, type_of(x))
        return list_of(t)
    if isinstance(v, Pair):
        return "any"
    return "int" if isinstance(v, int) else "number"


def join_types(a: object, b: object) -> object:
    """The smallest column type that holds both."""
    if a == b or b == "never":
        return a
    if a == "never":
        return b
    if isinstance(a, tuple) and isinstance(b, tuple):
        return list_of(join_types(a[1], b[1]))
    if a in NUMERIC and b in NUMERIC:
        return "real"
    return "any"


def is_subtype(a: object, b: object) -> bool:
    """In the language, where number holds all of them."""
    if a == "never" or b == "any" or a == b:
        return True
    if isinstance(a, tuple) and isinstance(b, tuple):
        return is_subtype(a[1], b[1])
    return a in NUMERIC and b in ("number", "real")


def meet_types(a: object, b: object) -> object:
    """The largest type that both hold; None if no value has both."""
    if is_subtype(a, b):
        return a
    if is_subtype(b, a):
        return b
    if isinstance(a, tuple) and isinstance(b, tuple):
        inner = meet_types(a[1], b[1])
        return list_of("never" if inner is None else inner)
    return None


def wider_type(a: object, b: object) -> object:
    """The smallest type of the language that holds both."""
    if is_subtype(a, b):
        return b
    if is_subtype(b, a):
        return a
    if isinstance(a, tuple) and isinstance(b, tuple):
        return list_of(wider_type(a[1], b[1]))
    return "any"


def holds(v: object, t: object) -> bool:
    """Whether a value has a type."""
    return t == "any" or is_subtype(type_of(v), t) and (not isinstance(v, Pair))
