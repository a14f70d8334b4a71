"""CR2 of weighted models, exact where weights differ within a cell.

A row's working variance is its variance function over its weight. Rows of a cluster with the same factor levels and the same weight are
alike in all that the adjustment sees, so they are one cell of the root of their number; rows of other weights are another cell. The
adjustment of a cluster takes a root of a matrix over its cells, which no smaller matrix stands for, so it is taken where the cluster's
cells are, on the executors, one cluster a group of at most MOST_IN_CLUSTER cells. With scaled design T, adjustment A and residuals r, a
cluster hands back T'A r, T'A'T and T'A A'T, of p and p x p numbers; from those the covariance, the degrees of freedom and the Hotelling
test follow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import cell_table, collect_cells
from .design import Formula
from .dist import f_upper, t_two_sided
from .glm import Fit, fit
from .sandwich import adjustment

#: Cells of a cluster, with a matrix of their square in a task.
MOST_IN_CLUSTER = 6000


@dataclass
class Weighted:
    fit: Fit
    cov: np.ndarray
    #: Of each cluster: T'A'T and T'AA'T.
    parts: list[tuple[np.ndarray, np.ndarray]]

    def products(self, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """(clusters, clusters): of what the clusters' parts of two contrasts are made of, in independent unit errors on rows."""
        m = self.fit.bread
        out = -np.array([x @ m @ c for x, _ in self.parts]) @ m @ np.array([x @ m @ d for x, _ in self.parts]).T
        out[np.diag_indices(len(out))] += [c @ m @ z @ m @ d for _, z in self.parts]
        return out

    def df(self, c: np.ndarray) -> float:
        """Satterthwaite degrees of freedom of a contrast."""
        k = self.products(c, c)
        return float(np.trace(k) ** 2 / (k**2).sum())

    def coefficients(self) -> list[dict]:
        """Estimate, standard error, t, Satterthwaite df and p of each coefficient."""
        out = []
        for i, name in enumerate(self.fit.names):
            se, df = float(np.sqrt(self.cov[i, i])), self.df(np.eye(len(self.fit.beta))[i])
            t = float(self.fit.beta[i] / se) if se else float("nan")
            out.append({"term": name, "estimate": float(self.fit.beta[i]), "se": se, "t": t, "df": df, "p": t_two_sided(t, df) if se else float("nan")})
        return out

    def wald(self, picks: list[int]) -> dict:
        """Joint test that these coefficients are zero: approximate Hotelling T squared."""
        c, q, b = np.eye(len(self.fit.beta))[picks], len(picks), self.fit.beta[picks]
        stat = float(b @ np.linalg.pinv(c @ self.cov @ c.T) @ b)
        e, u = np.linalg.eigh(c @ self.fit.bread @ c.T)
        half = (u / np.sqrt(np.maximum(e, 1e-300))) @ u.T @ c
        k = [[self.products(x, y) for y in half] for x in half]
        total = sum(float((k[i][i] * k[j][j]).sum() + (k[i][j] * k[i][j].T).sum()) for i in range(q) for j in range(q))
        eta = q * (q + 1) / total
        d2 = eta - q + 1
        f = d2 / (eta * q) * stat
        return {"statistic": stat, "F": f, "df1": q, "df2": d2, "p": f_upper(f, q, d2) if d2 > 0 else float("nan")}


def weighted_model(df: DataFrame, y: Column, cluster: str, formula: Formula, weight: Column, link: str = "logit") -> Weighted:
    """A weighted share model with its CR2 covariance. The driver gets a cell's sums, and p x p numbers for each cluster; rows without a weight, or with one of 0 or less, are left out."""
    rows = df.withColumn("_w", weight.cast("double")).where("_w > 0")
    f = fit(collect_cells(cell_table(rows, y, cluster, formula.factors, F.col("_w")), formula.factors), formula, link)
    beta, bread, design = f.beta, f.bread, f.formula
    cells = rows.select(F.col(cluster).alias("cluster"), *design.factors, y.cast("double").alias("y"), "_w").dropna().groupBy("cluster", *design.factors, "_w").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))

    def run(table):
        import pyarrow as pa

        if table.num_rows > MOST_IN_CLUSTER:
            raise ValueError(f"a cluster has over {MOST_IN_CLUSTER} cells of different levels and weights")
        col = lambda c: np.array(table[c].to_pylist(), object)
        x = design.matrix({k: col(k) for k in design.factors})
        n, s, w = (table[c].to_numpy().astype(float) for c in ("n", "s", "_w"))
        eta = x @ beta
        mu = 1 / (1 + np.exp(-np.clip(eta, -35, 35))) if link == "logit" else eta
        v = np.maximum(mu * (1 - mu), 1e-300) if link == "logit" else np.ones_like(mu)
        t = x * np.sqrt(n * w * v)[:, None]
        r = np.sqrt(n * w / v) * (s / n - mu)
        a = adjustment(t, bread, v / w)
        u = a.T @ t
        lists = [pa.array([z.ravel().tolist()], pa.list_(pa.float64())) for z in (t.T @ (a @ r), t.T @ u, u.T @ u)]
        return pa.table([table["cluster"][:1], *lists], names=["cluster", "score", "x", "z"])

    kind = cells.schema["cluster"].dataType.simpleString()
    found = cells.groupBy("cluster").applyInArrow(run, f"cluster {kind}, score array<double>, x array<double>, z array<double>").collect()  # a row a cluster
    p = len(beta)
    scores = np.array([r["score"] for r in found])
    return Weighted(f, bread @ scores.T @ scores @ bread, [(np.array(r["x"]).reshape(p, p), np.array(r["z"]).reshape(p, p)) for r in found])
