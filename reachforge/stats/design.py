"""Design matrices of factors with treatment coding, and their interactions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Formula:
    """terms: factor names, or 'a:b' for an interaction; levels: declared order of each factor, the first one being the reference."""

    terms: tuple[str, ...]
    levels: dict[str, list[str]]

    @property
    def factors(self) -> list[str]:
        return list(dict.fromkeys(f for t in self.terms for f in t.split(":")))

    def present(self, data: dict[str, np.ndarray]) -> Formula:
        """Only the levels that occur, in declared order."""
        return Formula(self.terms, {f: [v for v in self.levels[f] if (data[f] == v).any()] for f in self.factors})

    def names(self) -> list[str]:
        return ["(Intercept)"] + [":".join(c) for t in self.terms for c in self._columns(t)]

    def _columns(self, term: str):
        out = [()]
        for f in term.split(":"):
            out = [(*c, f"{f}={v}") for c in out for v in self.levels[f][1:]]
        return out

    def matrix(self, data: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(data.values())))
        cols = [np.ones(n)]
        for t in self.terms:
            for c in self._columns(t):
                x = np.ones(n)
                for part in c:
                    f, v = part.split("=", 1)
                    x = x * (data[f] == v)
                cols.append(x)
        return np.column_stack(cols)

    def picks(self, term: str) -> list[int]:
        """The coefficients of a term."""
        names = self.names()
        return [names.index(":".join(c)) for c in self._columns(term)]
