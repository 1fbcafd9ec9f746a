"""The dot commands of a session, as counted blocks."""

from __future__ import annotations

from collections.abc import Callable

from stratalog.engine import Engine
from stratalog.functions.values import DatalogError, InvalidSyntax
from stratalog.plans.ir import type_text
from stratalog.sources.programs import Folder
from stratalog.sources.text import block, error_block, table_block, text_block


class Session:
    """Answers one line at a time: a program, or a command that begins with a dot."""

    def __init__(self, engine: Engine, folder: Folder | None = None):
        self.engine, self.folder, self.ended = engine, folder, False

    def answer(self, line: str) -> str:
        try:
            if not line.startswith("."):
                return block(self.engine.execute(line))
            name, *rest = line[1:].split()
            command: Callable[..., str] | None = getattr(self, f"do_{name}", None)
            if command is None:
                raise InvalidSyntax(f"no command .{name}")
            return command(*rest)
        except DatalogError as error:
            return error_block(error)
        except TypeError:
            return error_block(InvalidSyntax(f"wrong arguments: {line}"))

    def do_predicates(self) -> str:
        return text_block([f"{n}/{k}" for n, k in self.engine.predicates()])

    def do_schema(self, name: str) -> str:
        columns = self.engine.schema_columns(name) or ()
        return text_block([f"{c or k + 1}: {type_text(t)}" for k, (c, t) in enumerate(columns)])

    def do_rows(self, key: str, *rest: str) -> str:
        """NAME/ARITY [OFFSET [LIMIT]] [origin] [by POS [asc|desc]...]"""
        name, _, arity = key.rpartition("/")
        words = list(rest)
        numbers = [int(words.pop(0)) for _ in range(2) if words and words[0].isdigit()]
        origin = bool(words) and words[0] == "origin" and bool(words.pop(0))
        by: list[tuple[int, bool]] = []
        if words and words.pop(0) != "by":
            raise InvalidSyntax(f"rows {key}: {' '.join(rest)}")
        while words:
            at = words.pop(0)
            if not at.isdigit() or not 1 <= int(at) <= int(arity):
                raise InvalidSyntax(f"no column {at}")
            by.append((int(at) - 1, bool(words) and words[0] in ("asc", "desc") and words.pop(0) == "desc"))
        page = self.engine.rows(name, int(arity), *numbers, by=by)
        return table_block(page if origin else page.drop("origin"))

    def do_status(self) -> str:
        return text_block([f"{k}: {v}" for k, v in self.engine.maintenance_stats().items()])

    def do_explain(self, *goals: str) -> str:
        return text_block(self.engine.explain_query(" ".join(goals)).splitlines())

    def do_files(self) -> str:
        return text_block(sorted(self.folder.files) if self.folder else [])

    def do_errors(self) -> str:
        return text_block([f"{n}: {e}" for n, e in sorted(self.folder.errors.items())] if self.folder else [])

    def do_reload(self) -> str:
        return text_block(self.folder.sync() if self.folder else [])

    def do_watch(self) -> str:
        return text_block([f"generation {self.engine.generation}"])

    def do_help(self) -> str:
        return text_block(sorted(f".{n[3:]}" for n in dir(self) if n.startswith("do_")))

    def do_quit(self) -> str:
        self.ended = True
        return text_block([])
