"""Cluster-robust covariance with small-sample corrections, on cells.

In a cluster the n equal rows of a cell act as one row scaled by the root of n: what is orthogonal to the cell's mean meets neither
the design nor the corrections, so CR2, Satterthwaite degrees of freedom and the Hotelling test equal those over rows. The adjustment
of a cluster is D'(D R D')^(-1/2) D, where D D' is its working variance and R the working variance of its residuals; as the working
variance of a logit model differs between the cells of a cluster, this is not the inverse root on the scale of unit errors. Sources:
Bell and McCaffrey 2002; Pustejovsky and Tipton 2018; Zhang 2012.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .dist import f_upper, t_two_sided
from .glm import Fit


@dataclass
class Robust:
    """Of each cluster: its rows of the scaled design (t), and its adjustment (a) of residuals in units of the working standard deviation."""

    fit: Fit
    groups: list[np.ndarray]
    t: np.ndarray
    r: np.ndarray
    adjust: list[np.ndarray]
    cov: np.ndarray

    def residual_map(self, c: np.ndarray) -> np.ndarray:
        """(clusters, cells): what each cluster's part of c.beta is made of; independent unit errors on cells."""
        out = np.zeros((len(self.groups), len(self.t)))
        for g, (rows, a) in enumerate(zip(self.groups, self.adjust, strict=True)):
            u = a.T @ self.t[rows] @ self.fit.bread @ c
            out[g, rows] += u
            out[g] -= self.t @ (self.fit.bread @ (self.t[rows].T @ u))
        return out

    def df(self, c: np.ndarray) -> float:
        """Satterthwaite degrees of freedom of a contrast."""
        p = self.residual_map(c)
        k = p @ p.T
        return float(np.trace(k) ** 2 / (k**2).sum())


def adjustment(t: np.ndarray, bread: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Of a cluster with these rows of the scaled design and working variances phi: what is applied to residuals in units of the working standard deviation."""
    phi = phi / phi.mean()  # only their proportions count
    b = phi[:, None] * (np.eye(len(t)) - t @ bread @ t.T) * phi[None, :]
    e, q = np.linalg.eigh((b + b.T) / 2)
    least = 1e-10 * max(e.max(), 1e-300)
    return ((q * np.where(e > least, 1 / np.sqrt(np.maximum(e, least)), 0.0)) @ q.T) * phi[None, :]


def robust(fit: Fit, kind: str = "CR2") -> Robust:
    """kind: CR0, CR1S or CR2."""
    c = fit.cells
    v = np.maximum(fit.variance(fit.mu), 1e-300)
    w = c.n * v
    t = fit.x * np.sqrt(w)[:, None]  # working-model scale: unit errors on rows of t
    r = np.sqrt(c.n / v) * (c.s / c.n - fit.mu)
    groups = [np.flatnonzero(c.cluster == g) for g in dict.fromkeys(c.cluster)]
    adjust = []
    for rows in groups:
        if kind != "CR2":
            adjust.append(np.eye(len(rows)))
            continue
        adjust.append(adjustment(t[rows], fit.bread, v[rows]))
    meat = np.zeros((len(fit.beta),) * 2)
    for rows, a in zip(groups, adjust, strict=True):
        u = t[rows].T @ (a @ r[rows])
        meat += np.outer(u, u)
    cov = fit.bread @ meat @ fit.bread
    if kind == "CR1S":
        g, n, p = len(groups), fit.n, len(fit.beta)
        cov *= g * (n - 1) / ((g - 1) * (n - p))
    return Robust(fit, groups, t, r, adjust, cov)


def coefficient_tests(v: Robust) -> list[dict]:
    """Estimate, standard error, t, Satterthwaite df and p of each coefficient."""
    out = []
    for i, name in enumerate(v.fit.names):
        c = np.eye(len(v.fit.beta))[i]
        se, df = float(np.sqrt(v.cov[i, i])), v.df(c)
        t = float(v.fit.beta[i] / se) if se else float("nan")
        out.append({"term": name, "estimate": float(v.fit.beta[i]), "se": se, "t": t, "df": df, "p": t_two_sided(t, df) if se else float("nan")})
    return out


def wald(v: Robust, picks: list[int]) -> dict:
    """Joint test that these coefficients are zero: approximate Hotelling T squared."""
    c = np.eye(len(v.fit.beta))[picks]
    q = len(picks)
    b = c @ v.fit.beta
    stat = float(b @ np.linalg.pinv(c @ v.cov @ c.T) @ b)
    e, u = np.linalg.eigh(c @ v.fit.bread @ c.T)
    half = (u / np.sqrt(np.maximum(e, 1e-300))) @ u.T  # standardises by the working covariance
    maps = [v.residual_map(row) for row in half @ c]
    k = [[a @ b2.T for b2 in maps] for a in maps]
    total = sum(float((k[s][s] * k[t][t]).sum() + (k[s][t] * k[s][t].T).sum()) for s in range(q) for t in range(q))
    eta = q * (q + 1) / total
    d2 = eta - q + 1
    f = d2 / (eta * q) * stat
    return {"statistic": stat, "F": f, "df1": q, "df2": d2, "p": f_upper(f, q, d2) if d2 > 0 else float("nan")}
