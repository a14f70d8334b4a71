"""Weighted CR2 on cells against matrices over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachforge.plans.pipelines import share_model
from reachforge.stats import sandwich, weighted
from reachforge.stats.dist import f_upper
from reachforge.stats.design import Formula

FORMULA = Formula(("a", "b"), {"a": ["x", "y", "z"], "b": ["p", "q"]})


def rows(seed, clusters=8):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(clusters):
        for _ in range(int(rng.integers(6, 20))):
            a, b = str(rng.choice(["x", "y", "z"])), str(rng.choice(["p", "q"]))
            out.append((f"g{g}", a, b, float(np.clip(rng.beta(2, 3) + 0.1 * (a == "y") + 0.02 * g, 0, 1)), float(rng.integers(1, 400)) / 10))
    return out


class Brute:
    """By the definition: matrices over rows; the working variance of a row is v / w."""

    def __init__(self, data, link):
        y, w = np.array([r[3] for r in data]), np.array([r[4] for r in data])
        x = FORMULA.matrix({"a": np.array([r[1] for r in data], object), "b": np.array([r[2] for r in data], object)})
        beta = np.zeros(x.shape[1])
        for _ in range(60):
            eta = x @ beta
            mu = 1 / (1 + np.exp(-eta)) if link == "logit" else eta
            slope = mu * (1 - mu) if link == "logit" else np.ones_like(mu)
            beta = beta + np.linalg.solve(x.T @ (x * (w * slope)[:, None]), x.T @ (w * (y - mu)))
        v = mu * (1 - mu) if link == "logit" else np.ones_like(mu)
        d = x * v[:, None]  # the slope of the mean
        big = np.diag(w / v)
        phi = np.diag(v / w)
        m = np.linalg.inv(d.T @ big @ d)
        hat = d @ m @ d.T @ big
        spread = (np.eye(len(y)) - hat) @ phi @ (np.eye(len(y)) - hat).T
        cluster = np.array([r[0] for r in data], object)
        self.beta, self.m, self.maps, meat = beta, m, [], np.zeros_like(m)
        for g in dict.fromkeys(cluster):
            j = np.flatnonzero(cluster == g)
            root = np.sqrt(phi[np.ix_(j, j)])
            e, u = np.linalg.eigh(root @ spread[np.ix_(j, j)] @ root)
            adjust = root @ ((u * np.where(e > 1e-10, 1 / np.sqrt(np.maximum(e, 1e-10)), 0)) @ u.T) @ root
            to_beta = m @ d[j].T @ big[np.ix_(j, j)] @ adjust
            meat += np.outer(to_beta @ (y - mu)[j], to_beta @ (y - mu)[j])
            self.maps.append(to_beta @ (np.eye(len(y)) - hat)[j] @ np.sqrt(phi))
        self.cov = meat
        self.working = m @ d.T @ big @ phi @ big @ d @ m

    def products(self, c, d):
        return np.array([[(c @ p) @ (d @ q) for q in self.maps] for p in self.maps])

    def df(self, c):
        k = self.products(c, c)
        return np.trace(k) ** 2 / (k**2).sum()

    def wald(self, picks):
        c = np.eye(len(self.beta))[picks]
        q, b = len(picks), self.beta[picks]
        e, u = np.linalg.eigh(c @ self.working @ c.T)
        half = (u / np.sqrt(e)) @ u.T @ c
        k = [[self.products(x, y) for y in half] for x in half]
        total = sum((k[i][i] * k[j][j]).sum() + (k[i][j] * k[i][j].T).sum() for i in range(q) for j in range(q))
        eta = q * (q + 1) / total
        return f_upper((eta - q + 1) / (eta * q) * (b @ np.linalg.inv(c @ self.cov @ c.T) @ b), q, eta - q + 1)


def frame(spark, data):
    return spark.createDataFrame([*data, (None, "x", "p", 0.5, 1.0), ("g0", "x", "p", None, 1.0), ("g0", "x", "p", 0.5, None)], "g string, a string, b string, y double, w double")


def like(got, want):
    np.testing.assert_allclose(got["cov"], want.cov, rtol=1e-6, atol=1e-12)
    for i, x in enumerate(got["tests"]):
        assert x["df"] == pytest.approx(want.df(np.eye(4)[i]), rel=1e-6)
    for picks, p in got["joint"].items():
        assert p == pytest.approx(want.wald(list(picks)), rel=1e-5)


PICKS = [(1,), (1, 2), (1, 2, 3)]


@pytest.mark.parametrize("link", ["logit", "identity"])
@pytest.mark.parametrize("seed", [1, 2])
def test_weights_that_differ_within_cells(spark, link, seed):
    data = rows(seed)
    got = weighted.weighted_model(frame(spark, data), F.col("y"), "g", FORMULA, F.col("w"), link)
    want = Brute(data, link)
    np.testing.assert_allclose(got.fit.beta, want.beta, atol=1e-8)
    like({"cov": got.cov, "tests": got.coefficients(), "joint": {k: got.wald(list(k))["p"] for k in PICKS}}, want)


@pytest.mark.parametrize("link", ["logit", "identity"])
def test_models_without_weights_on_cells(spark, link):
    data = [(*r[:4], 1.0) for r in rows(3)]
    got = share_model(frame(spark, data).where("w = 1"), F.col("y"), "g", FORMULA, link=link)
    like({"cov": got.robust.cov, "tests": got.coefficients(), "joint": {k: sandwich.wald(got.robust, list(k))["p"] for k in PICKS}}, Brute(data, link))


def test_equal_weights_give_the_unweighted_model(spark):
    data = [(*r[:4], 2.5) for r in rows(4)]
    a = weighted.weighted_model(frame(spark, data), F.col("y"), "g", FORMULA, F.col("w"))
    b = share_model(frame(spark, data).where("w IS NOT NULL"), F.col("y"), "g", FORMULA)
    np.testing.assert_allclose(a.cov, b.robust.cov, rtol=1e-7)
    assert [x["df"] for x in a.coefficients()] == pytest.approx([x["df"] for x in b.coefficients()], rel=1e-6)


def test_a_cluster_of_too_many_cells_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(weighted, "MOST_IN_CLUSTER", 3)
    with pytest.raises(Exception, match="cells of different levels and weights"):
        weighted.weighted_model(frame(spark, rows(1)), F.col("y"), "g", FORMULA, F.col("w"))
