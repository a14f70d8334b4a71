import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachforge.plans.pipelines import share_model
from reachforge.stats import dist, effects, sandwich, tests
from reachforge.stats.cells import Cells
from reachforge.stats.design import Formula
from reachforge.stats.glm import fit


def test_tails_at_known_points():
    assert dist.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-10)
    assert dist.f_upper(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert dist.chi2_upper(50, 2) == pytest.approx(math.exp(-25), rel=1e-10)
    assert dist.normal_quantile(0.95) == pytest.approx(1.959963984540054, abs=1e-9)
    assert dist.t_quantile(0.95, 10) == pytest.approx(2.2281388519649385, abs=1e-8)
    assert dist.holm([0.01, 0.04, 0.03]) == pytest.approx([0.03, 0.06, 0.06])


def rows(seed=1, clusters=9):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(clusters):
        for _ in range(int(rng.integers(8, 30))):
            a, b = str(rng.choice(["x", "y", "z"])), str(rng.choice(["p", "q"]))
            out.append((f"g{g}", a, b, float(np.clip(rng.beta(2, 3) + 0.1 * (a == "y") + 0.02 * g, 0, 1))))
    return out


FORMULA = Formula(("a", "b"), {"a": ["x", "y", "z"], "b": ["p", "q"]})


def as_cells(data, collapse=True):
    keys = sorted({r[:3] for r in data}) if collapse else [(*r[:3], i) for i, r in enumerate(data)]
    pick = (lambda k: [r[3] for r in data if r[:3] == k]) if collapse else (lambda k: [data[k[3]][3]])
    ys = [np.array(pick(k)) for k in keys]
    col = lambda i: np.array([k[i] for k in keys], object)
    return Cells(col(0), {"a": col(1), "b": col(2)}, np.array([len(y) for y in ys], float), np.array([y.sum() for y in ys]), np.array([(y**2).sum() for y in ys]))


@pytest.mark.parametrize("kind", ["CR0", "CR1S", "CR2"])
@pytest.mark.parametrize("link", ["logit", "identity"])
def test_cells_give_what_rows_give(kind, link):
    data = rows()
    a, b = (sandwich.robust(fit(as_cells(data, c), FORMULA, link), kind) for c in (True, False))
    assert a.fit.converged
    np.testing.assert_allclose(a.fit.beta, b.fit.beta, atol=1e-9)
    np.testing.assert_allclose(a.cov, b.cov, atol=1e-10)
    for x, y in zip(sandwich.coefficient_tests(a), sandwich.coefficient_tests(b), strict=True):
        assert x["df"] == pytest.approx(y["df"], rel=1e-7)
    assert sandwich.wald(a, [1, 2])["p"] == pytest.approx(sandwich.wald(b, [1, 2])["p"], rel=1e-6)


def test_cr2_of_single_rows_is_hc2():
    rng = np.random.default_rng(3)
    n = 40
    a = rng.choice(["x", "y", "z"], n).astype(object)
    y = rng.normal(size=n)
    cells = Cells(np.array([str(i) for i in range(n)], object), {"a": a}, np.ones(n), y, y**2)
    m = fit(cells, Formula(("a",), {"a": ["x", "y", "z"]}), "identity")
    h = np.einsum("ij,jk,ik->i", m.x, m.bread, m.x)
    want = m.bread @ (m.x.T @ (m.x * ((y - m.mu) ** 2 / (1 - h))[:, None])) @ m.bread
    np.testing.assert_allclose(sandwich.robust(m).cov, want, atol=1e-12)


def test_wald_of_one_constraint_is_the_t_test():
    v = sandwich.robust(fit(as_cells(rows(5)), FORMULA))
    t, w = sandwich.coefficient_tests(v)[1], sandwich.wald(v, [1])
    assert w["F"] == pytest.approx(t["t"] ** 2) and w["df2"] == pytest.approx(t["df"]) and w["p"] == pytest.approx(t["p"])


def test_saturated_model_predicts_means_and_leave_one_out_refits():
    data = rows(7)
    f = Formula(("a", "b", "a:b"), FORMULA.levels)
    m = fit(as_cells(data), f)
    for r in effects.observed_and_predicted(m, ["a", "b"]):
        assert r["observed"] == pytest.approx(r["predicted"], abs=1e-8)
    use = lambda m: {"y": m.beta[1]}
    got = effects.leave_one_out(as_cells(data), FORMULA, use)[0]
    direct = [fit(as_cells([r for r in data if r[0] != f"g{g}"]), FORMULA).beta[1] for g in range(9)]
    assert (got["low"], got["high"]) == (pytest.approx(min(direct)), pytest.approx(max(direct)))
    assert {t["term"] for t in effects.link_test(m)} == {"(Intercept)", "hat", "hat2"}
    v = sandwich.robust(m)
    assert len(effects.pairwise(sandwich.robust(fit(as_cells(data), Formula(("a",), {"a": ["x", "y", "z"]}))), "a")) == 3
    p = effects.average_predictions(m, v.cov, "a")
    c = effects.average_contrasts(m, v.cov, "a")
    assert c[0]["estimate"] == pytest.approx(p[1]["estimate"] - p[0]["estimate"])


def test_missing_levels_leave_the_design(spark):
    df = spark.createDataFrame([(g, a, y) for g, a, _, y in rows() if a != "y"] + [("g0", None, 0.5), ("g1", "x", None)], "g string, a string, y double")
    m = share_model(df, F.col("y"), "g", Formula(("a",), {"a": ["x", "y", "z"]}))
    assert m.fit.names == ["(Intercept)", "a=z"]
    assert m.predictions("a")[0]["estimate"] == pytest.approx(df.where("a = 'x'").agg(F.avg("y")).first()[0], abs=1e-9)


def test_contingency_and_ranks():
    r = tests.chi_square([[10, 20], [30, 40]])
    assert r["statistic"] == pytest.approx(0.7936507936507936) and r["df"] == 1 and r["p"] == pytest.approx(0.372998, abs=1e-5)
    assert tests.chi_square_simulated([[10, 20], [30, 40]], 2000, 1) == pytest.approx(0.5, abs=0.08)
    k = tests.kruskal_wallis([1, 2, 3, 4, 5, 6], ["a", "a", "a", "b", "b", "b"])
    assert k["statistic"] == pytest.approx(3.857142857142857) and k["p"] == pytest.approx(0.0495346, abs=1e-6)


def test_breusch_pagan_from_cell_moments():
    data = rows(11)
    cells = as_cells(data)
    third, fourth = ([sum(r[3] ** p for r in data if r[:3] == k) for k in sorted({r[:3] for r in data})] for p in (3, 4))
    got = tests.breusch_pagan(cells, FORMULA, np.array(fourth), np.array(third))
    full = as_cells(data, False)
    m = fit(full, FORMULA, "identity")
    e2 = (full.s - m.mu) ** 2
    fitted = m.x @ np.linalg.lstsq(m.x, e2, rcond=None)[0]
    want = len(data) * ((fitted - e2.mean()) ** 2).sum() / ((e2 - e2.mean()) ** 2).sum()
    assert got["statistic"] == pytest.approx(want)
