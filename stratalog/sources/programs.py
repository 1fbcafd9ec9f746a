"""Programs from files and from folders of files, each file a contributor whose facts come and go with it."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from stratalog.engine import Engine
from stratalog.functions.values import DatalogError, InvalidFact
from stratalog.plans.ir import Const, Fact, Rule, Schema
from stratalog.plans.parser import parse_program

SUFFIX = ".dl"


def run_file(engine: Engine, path: str) -> object:
    """Run a program file; its last statement's result."""
    with open(path, encoding="utf-8") as f:
        return engine.execute(f.read())


@dataclass
class _File:
    text: str
    facts: list = field(default_factory=list)
    rules: list = field(default_factory=list)
    error: DatalogError | None = None


class Folder:
    """All program files below a folder. ``sync`` takes in what changed since the last time.

    Files hold facts, rules and schemas; a file that can't be read as such contributes nothing and stands in
    ``errors`` until it is mended. Facts two files share stay while one of them holds them; a rule goes with the last file
    that holds it, unless the engine had it before.
    """

    def __init__(self, engine: Engine, root: str):
        self.engine, self.root, self.files = engine, root, {}
        self.own = tuple(engine.state.rules)

    @property
    def errors(self) -> dict[str, DatalogError]:
        return {name: f.error for name, f in self.files.items() if f.error is not None}

    def read(self) -> dict[str, str]:
        found = {}
        for folder, _, names in sorted(os.walk(self.root)):
            for name in sorted(names):
                if name.endswith(SUFFIX):
                    path = os.path.join(folder, name)
                    with open(path, encoding="utf-8") as f:
                        found[os.path.relpath(path, self.root)] = f.read()
        return found

    def sync(self) -> list[str]:
        """The names of files that were new, changed or gone."""
        now = self.read()
        moved = sorted(n for n in {*now, *self.files} if n not in now or n not in self.files or self.files[n].text != now[n])
        rules_moved = False
        for name in moved:
            old = self.files.pop(name, None)
            rules_moved |= bool(old and old.rules)
            if name in now:
                self.files[name] = new = self.parsed(now[name])
                rules_moved |= bool(new.rules)
        if rules_moved:
            wanted = list(self.own)
            for f in self.files.values():
                wanted += [r for r in f.rules if r not in wanted]
            self.engine.replace_rules(wanted)
        for name in moved:
            f = self.files.get(name)
            try:
                self.engine.set_contribution(name, f.facts if f else [])
            except DatalogError as error:
                f.error = error
        return moved

    def parsed(self, text: str) -> _File:
        out = _File(text)
        try:
            for s in parse_program(text):
                if isinstance(s, Fact):
                    if not all(isinstance(t, Const) for t in s.head.args):
                        raise InvalidFact(str(s.head))
                    out.facts.append((s.head.key, tuple(t.value for t in s.head.args)))
                elif isinstance(s, Rule):
                    out.rules.append(self.engine.admitted(s, [r for f in self.files.values() for r in f.rules] + out.rules))
                elif isinstance(s, Schema):
                    self.engine.declare_schema(s)
                else:
                    raise InvalidFact("files of a folder hold no questions and retractions")
        except DatalogError as error:
            return _File(text, error=error)
        return out
