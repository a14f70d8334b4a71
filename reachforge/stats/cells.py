"""Sufficient statistics: rows with the same cluster and the same factor levels are one cell."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More cells than this are no small table of factors.
MOST_CELLS = 100_000


@dataclass
class Cells:
    """n: rows, s: sum of y, q: sum of y squared; levels: a column of level names for each factor."""

    cluster: np.ndarray
    levels: dict[str, np.ndarray]
    n: np.ndarray
    s: np.ndarray
    q: np.ndarray

    def take(self, keep: np.ndarray) -> Cells:
        return Cells(self.cluster[keep], {k: v[keep] for k, v in self.levels.items()}, self.n[keep], self.s[keep], self.q[keep])

    def without(self, cluster: str) -> Cells:
        """Leaves one cluster out; no rescan."""
        return self.take(self.cluster != cluster)


def cell_table(df: DataFrame, y: Column, cluster: str, factors: list[str], weight: Column | None = None) -> DataFrame:
    """One row a cell; rows with a null in y, cluster or a factor are left out. With a weight, sums are weighted."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = df.select(F.col(cluster).alias("cluster"), *factors, y.cast("double").alias("y"), w.alias("w")).dropna()
    return rows.groupBy("cluster", *factors).agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("s"), F.sum(F.col("w") * F.col("y") * F.col("y")).alias("q"))


def collect_cells(table: DataFrame, factors: list[str]) -> Cells:
    rows = table.orderBy("cluster", *factors).limit(MOST_CELLS + 1).collect()
    if len(rows) > MOST_CELLS:
        raise ValueError("too many cells: a factor has too many levels")
    col = lambda c: np.array([r[c] for r in rows], float)
    return Cells(np.array([r["cluster"] for r in rows], object), {f: np.array([r[f] for r in rows], object) for f in factors}, col("n"), col("s"), col("q"))
