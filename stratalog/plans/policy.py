"""Whether to maintain a changed recursive predicate or to rebuild it."""

from __future__ import annotations

from dataclasses import dataclass

#: One decision in so many goes the other way, so that both estimates stay fresh.
EXPLORE_EVERY = 16


@dataclass
class CostModel:
    """Means of what either way took, each new run with half the weight; what was never tried is tried first.

    ``mode``: automatic, incremental (always maintain) or recompute (always rebuild).
    """

    mode: str = "automatic"
    maintain_s: float | None = None
    rebuild_s: float | None = None
    decisions: int = 0

    def maintain(self) -> bool:
        if self.mode != "automatic":
            return self.mode == "incremental"
        self.decisions += 1
        better = self.maintain_s is None or self.rebuild_s is not None and self.maintain_s <= self.rebuild_s
        return better != (self.decisions % EXPLORE_EVERY == 0)

    def saw(self, way: str, seconds: float) -> None:
        name = f"{way}_s"
        old = getattr(self, name)
        setattr(self, name, seconds if old is None else (old + seconds) / 2)
