"""Typed access to single answers."""

from __future__ import annotations

from collections.abc import Mapping

from stratalog.functions.values import Atom, TypeMismatch, UnknownVariable


class Answer(Mapping):
    """One answer by variable. The accessors convert nothing: a value of another type is an error."""

    def __init__(self, values: dict[str, object]):
        self.values_by_name = values

    def __getitem__(self, name: str) -> object:
        if name not in self.values_by_name:
            raise UnknownVariable(name)
        return self.values_by_name[name]

    def __iter__(self):
        return iter(self.values_by_name)

    def __len__(self) -> int:
        return len(self.values_by_name)

    def _of(self, name: str, kind: type, said: str) -> object:
        v = self[name]
        if not isinstance(v, kind) or isinstance(v, bool):
            raise TypeMismatch(f"{name} is no {said}")
        return v

    def get_atom(self, name: str) -> str:
        return str(self._of(name, Atom, "atom"))

    def get_integer(self, name: str) -> int:
        return self._of(name, int, "integer")

    def get_float(self, name: str) -> float:
        return self._of(name, float, "float")

    def get_value(self, name: str) -> object:
        return self[name]
