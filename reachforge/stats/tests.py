"""Contingency tests, heteroscedasticity, and rank tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import settled
from .cells import Cells
from .design import Formula
from .dist import chi2_upper
from .glm import fit
from .selection import quantile_columns


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, row_share) of all pairs that occur."""
    g = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def chi_square_columns(df: DataFrame, a: str, b: str) -> DataFrame:
    """statistic, df, n, cramers_v and the share of cells with an expected count under 5, in one row; all in the engine."""
    g = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = g.select(a).distinct(), g.select(b).distinct()
    full = rows.join(cols, F.lit(True)).join(g, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))  # levels of two factors
    total = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    e = full.withColumn("e", total(a) * total(b) / total())
    s = e.agg(F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("statistic"), F.countDistinct(a).alias("r"), F.countDistinct(b).alias("c"), F.sum("n").alias("n"), F.avg((F.col("e") < 5).cast("double")).alias("small_share"))
    return s.select("statistic", ((F.col("r") - 1) * (F.col("c") - 1)).alias("df"), "n", F.sqrt(F.col("statistic") / (F.col("n") * (F.least("r", "c") - 1))).alias("cramers_v"), "small_share")


def chi_square(table: np.ndarray) -> dict:
    t = np.asarray(table, float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    stat, df = float(((t - e) ** 2 / e).sum()), (t.shape[0] - 1) * (t.shape[1] - 1)
    return {"statistic": stat, "df": df, "p": chi2_upper(stat, df), "cramers_v": float(np.sqrt(stat / (t.sum() * (min(t.shape) - 1)))), "expected": e, "small_share": float((e < 5).mean())}


def exceeds(table: np.ndarray, draws, seed: int) -> int:
    """How many of the draws, by their numbers, give a table with the same margins and a statistic at least as large. A draw's random numbers come from its number and the seed alone, so it is the same wherever it is made."""
    t = np.asarray(table, int)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    stat, hits = ((t - e) ** 2 / e).sum(), 0
    for d in draws:
        rng = np.random.Generator(np.random.Philox(key=[seed, int(d)]))
        left, rows = t.sum(0).copy(), []
        for r in t.sum(1)[:-1]:
            rows.append(rng.multivariate_hypergeometric(left, r))
            left = left - rows[-1]
        hits += ((np.array([*rows, left]) - e) ** 2 / e).sum() >= stat - 1e-9
    return int(hits)


def chi_square_simulated(table: np.ndarray, draws: int = 10_000, seed: int = 0, spark: SparkSession | None = None) -> float:
    """Monte-Carlo p value over tables with the same margins. With a session the draws are made on its executors, which hand back their numbers of hits; the p value is the same, however the draws are dealt out."""
    if spark is None:
        return (exceeds(table, range(draws), seed) + 1) / (draws + 1)

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([sum(exceeds(table, b.column(0).to_pylist(), seed) for b in batches)], pa.int64())], ["hits"])

    hits = spark.range(draws).mapInArrow(run, "hits long").agg(F.sum("hits")).first()[0]
    return (hits + 1) / (draws + 1)


def simulated_test(df: DataFrame, a: str, b: str, draws: int = 10_000, seed: int = 0, most: int = 10_000) -> dict:
    """Chi-square of two factors with its simulated p value; the table of their levels, of at most `most` cells, is what reaches the driver."""
    rows = df.dropna(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("n")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many levels for a table")
    levels = [sorted({r[k] for r in rows}, key=str) for k in (0, 1)]
    table = np.zeros((len(levels[0]), len(levels[1])), int)
    for x, y, n in rows:
        table[levels[0].index(x), levels[1].index(y)] = n
    found = chi_square(table)
    return {"statistic": found["statistic"], "df": found["df"], "cramers_v": found["cramers_v"], "p_simulated": chi_square_simulated(table, draws, seed, df.sparkSession)}


def breusch_pagan(cells: Cells, formula: Formula, fourth: np.ndarray, third: np.ndarray) -> dict:
    """Studentised: N times the R squared of squared residuals on the design. third and fourth: sums of y to these powers by cell."""
    m = fit(cells, formula, link="identity")
    n, mu = cells.n, m.mu
    e2 = cells.q - 2 * mu * cells.s + n * mu**2
    e4 = fourth - 4 * mu * third + 6 * mu**2 * cells.q - 4 * mu**3 * cells.s + n * mu**4
    beta = np.linalg.lstsq(m.x * np.sqrt(n)[:, None], e2 / np.sqrt(n), rcond=None)[0]
    total = n.sum()
    mean = e2.sum() / total
    explained = float((n * (m.x @ beta - mean) ** 2).sum())
    stat = total * explained / float(e4.sum() - total * mean**2)
    df = m.x.shape[1] - 1
    return {"statistic": float(stat), "df": df, "p": chi2_upper(float(stat), df), "fitted_low": float(mu.min()), "fitted_high": float(mu.max())}


def kruskal_wallis(values, groups) -> dict:
    """On few values (means of clusters), with the correction for ties."""
    x, g = np.asarray(values, float), np.asarray(groups, object)
    order = np.argsort(x, kind="stable")
    rank = np.empty(len(x))
    s = x[order]
    start = 0
    ties = 0.0
    for end in range(1, len(s) + 1):
        if end == len(s) or s[end] != s[start]:
            rank[order[start:end]] = (start + end + 1) / 2
            ties += (end - start) ** 3 - (end - start)
            start = end
    n, names = len(x), list(dict.fromkeys(g))
    h = 12 / (n * (n + 1)) * sum(rank[g == k].sum() ** 2 / (g == k).sum() for k in names) - 3 * (n + 1)
    h /= 1 - ties / (n**3 - n)
    return {"statistic": float(h), "df": len(names) - 1, "p": chi2_upper(float(h), len(names) - 1)}


#: Rows of a group up to which its distinct values may be held to find its quantiles.
HELD = 1_000_000


def _sizes(d: DataFrame, by: list[str]) -> DataFrame:
    return d.groupBy(*by).agg(F.count("_y").alias("n"), F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("sd"), F.min("_y").alias("low"), F.max("_y").alias("high"))


def with_quantiles(df: DataFrame, y: Column, by: list[str], probabilities: list[float], held: int = HELD) -> DataFrame:
    """(by, n, mean, sd, low, high, q) of the rows with a value. While every group has at most `held` rows, one aggregation holds the distinct values of a group; the largest group's size is looked at first, and beyond it values are selected by counting (selection.py). Both are exact."""
    d = df.select(*by, y.cast("double").alias("_y")).where("_y IS NOT NULL")
    sizes = _sizes(d, by)
    if (sizes.agg(F.max("n")).first()[0] or 0) <= held:
        return d.groupBy(*by).agg(F.count("_y").alias("n"), F.avg("_y").alias("mean"), F.stddev_samp("_y").alias("sd"), F.min("_y").alias("low"), F.max("_y").alias("high"), F.percentile("_y", probabilities).alias("q"))
    sizes = settled(sizes)
    q = quantile_columns(d, "_y", by, sizes, probabilities).select(*[F.col(c).alias(f"_{c}") for c in by], "q")
    return sizes.join(q, [sizes[c].eqNullSafe(q[f"_{c}"]) for c in by] or F.lit(True)).select(*by, "n", "mean", "sd", "low", "high", "q")


def describe(df: DataFrame, y: Column, by: list[str], held: int = HELD) -> DataFrame:
    """N, mean, sd, median, least and greatest of a measure, by group."""
    return with_quantiles(df, y, by, [0.5], held).select(*by, "n", "mean", "sd", F.get("q", F.lit(0)).alias("median"), "low", "high")


def quantiles(df: DataFrame, y: Column, by: list[str], held: int = HELD) -> DataFrame:
    """Mean, sd, quartiles (linear interpolation), extremes and interquartile range."""
    g = with_quantiles(df, y, by, [0.0, 0.25, 0.5, 0.75, 1.0], held)
    return g.select(*by, "mean", "sd", *[F.get("q", F.lit(i)).alias(f"q{25 * i}") for i in range(5)], (F.get("q", F.lit(3)) - F.get("q", F.lit(1))).alias("iqr"))
