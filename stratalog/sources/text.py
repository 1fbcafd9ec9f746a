"""Results as text: lines for a terminal, and counted tab-separated blocks for a connection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stratalog.engine import Changed
from stratalog.functions.values import DatalogError, number_text


def shown(v: object) -> str:
    """A cell of an answer in canonical text. Lists and mixed values come as text already."""
    if isinstance(v, bool):
        return str(v).lower()
    return number_text(int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 2**63 else v) if isinstance(v, (int, float)) else str(v)


def lines(result: object) -> list[str]:
    """What a terminal shows: a line an answer, ``Yes.`` or ``No.`` for questions without variables and for changes."""
    if result is None:
        return []
    if isinstance(result, Changed):
        return ["Yes." if result.changed else "No."]
    if isinstance(result, DataFrame):
        rows = result.collect()
        if result.columns == ["yes"]:
            return ["Yes." if rows else "No."]
        return [", ".join(f"{c}: {shown(v)}" for c, v in zip(result.columns, r)) for r in rows] or ["No."]
    return str(result).splitlines()


def failure(error: DatalogError, source: str = "") -> list[str]:
    """An error, with the line it stands in and a caret under the place where that is known."""
    at = getattr(error, "at", None)
    if at is None or not source:
        return [f"error: {error}"]
    line = source.count("\n", 0, at)
    begin = source.rfind("\n", 0, at) + 1
    return [f"error: {error}", f"{line + 1}: {source.splitlines()[line]}", " " * (len(str(line + 1)) + 2 + at - begin) + "^"]


def _escaped(s: str) -> str:
    return s.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def table_block(df: DataFrame) -> str:
    """``ok table`` and how many rows, the column names, then the rows, all tab-separated."""
    rows = df.collect()
    body = ["\t".join(_escaped(c) for c in df.columns)] + ["\t".join(_escaped(shown(v)) for v in r) for r in rows]
    return "\n".join([f"ok table {len(rows)}", *body]) + "\n"


def text_block(said: list[str]) -> str:
    return "\n".join([f"ok text {len(said)}", *map(_escaped, said)]) + "\n"


def error_block(error: DatalogError) -> str:
    return f"error {error.code} {_escaped(str(error).partition(': ')[2])}\n"


def block(result: object) -> str:
    return table_block(result) if isinstance(result, DataFrame) else text_block(lines(result))


