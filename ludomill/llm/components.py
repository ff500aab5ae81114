"""Components: in rounds over a table, and in memory of one task."""

from __future__ import annotations

from ludomill.operators.components import components

__all__ = ["Forest", "components"]


class Forest:
    """Union-find over the few items one task holds."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
