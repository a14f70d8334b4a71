"""Logit models of shares in [0, 1], and least squares, on cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .cells import Cells
from .design import Formula


@dataclass
class Fit:
    formula: Formula
    cells: Cells
    x: np.ndarray
    beta: np.ndarray
    mu: np.ndarray
    bread: np.ndarray
    converged: bool
    link: str = "logit"

    @property
    def names(self) -> list[str]:
        return self.formula.names()

    @property
    def n(self) -> float:
        return float(self.cells.n.sum())

    def variance(self, mu: np.ndarray) -> np.ndarray:
        """The variance function, which is also the slope of the mean by the linear predictor."""
        return mu * (1 - mu) if self.link == "logit" else np.ones_like(mu)

    def dispersion(self) -> float:
        """Pearson's, over rows: the cells keep the sum of y squared."""
        c = self.cells
        rss = c.q - 2 * self.mu * c.s + c.n * self.mu**2
        return float((rss / self.variance(self.mu)).sum() / (self.n - len(self.beta)))


def fit(cells: Cells, formula: Formula, link: str = "logit", tol: float = 1e-10, most: int = 100) -> Fit:
    """Iteratively reweighted least squares. Levels that do not occur leave the design."""
    formula = formula.present(cells.levels)
    x, y = formula.matrix(cells.levels), cells.s / cells.n
    if link == "identity":
        bread = np.linalg.pinv(x.T @ (x * cells.n[:, None]))
        beta = bread @ x.T @ (cells.n * y)
        return Fit(formula, cells, x, beta, x @ beta, bread, True, link)
    mu = (cells.n * y + 0.5) / (cells.n + 1)
    eta, deviance, converged = np.log(mu / (1 - mu)), np.inf, False
    for _ in range(most):
        v = np.maximum(mu * (1 - mu), 1e-12)
        w = cells.n * v
        z = eta + (y - mu) / v
        beta = np.linalg.lstsq(x * np.sqrt(w)[:, None], z * np.sqrt(w), rcond=None)[0]
        eta = np.clip(x @ beta, -35, 35)
        mu = 1 / (1 + np.exp(-eta))
        now = -2 * float((cells.s * np.log(mu) + (cells.n - cells.s) * np.log1p(-mu)).sum())
        if abs(now - deviance) < tol * (abs(now) + 0.1):
            converged = True
            break
        deviance = now
    bread = np.linalg.pinv(x.T @ (x * (cells.n * mu * (1 - mu))[:, None]))
    return Fit(formula, cells, x, beta, mu, bread, converged)
