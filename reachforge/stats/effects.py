"""Average predictions, contrasts, odds ratios, link tests and leave-one-out ranges of a fitted model."""

from __future__ import annotations

from itertools import combinations

import numpy as np

from .cells import Cells
from .design import Formula
from .dist import holm, normal_quantile, normal_two_sided, t_quantile, t_two_sided
from .glm import Fit, fit
from .sandwich import Robust, coefficient_tests


def _mean(model: Fit, levels: dict, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The weighted mean prediction and its gradient."""
    x = model.formula.matrix(levels)
    mu = 1 / (1 + np.exp(-x @ model.beta)) if model.link == "logit" else x @ model.beta
    w = weight / weight.sum()
    return float(w @ mu), (w * model.variance(mu)) @ x


def _row(value: float, grad: np.ndarray, cov: np.ndarray, level: float) -> dict:
    se = float(np.sqrt(max(0.0, grad @ cov @ grad)))
    h = normal_quantile(level) * se
    return {"estimate": value, "se": se, "low": value - h, "high": value + h, "p": normal_two_sided(value / se) if se else float("nan")}


def average_predictions(model: Fit, cov: np.ndarray, variable: str, by: str | None = None, newdata: Cells | None = None, level: float = 0.95) -> list[dict]:
    """Counterfactual means: the variable is set to each level in turn, all else as in the sample or in newdata; within groups of `by` if given."""
    data = newdata or model.cells
    out = []
    for g in model.formula.levels[by] if by else [None]:
        keep = data.levels[by] == g if by else np.ones(len(data.n), bool)
        for v in model.formula.levels[variable]:
            levels = {k: x[keep] for k, x in data.levels.items()} | {variable: np.full(int(keep.sum()), v, object)}
            if keep.any():
                out.append(({"by": g} if by else {}) | {"level": v} | _row(*_mean(model, levels, data.n[keep]), cov, level))
    return out


def average_contrasts(model: Fit, cov: np.ndarray, variable: str, by: str | None = None, newdata: Cells | None = None, level: float = 0.95) -> list[dict]:
    """Differences of those means to the reference level's."""
    data = newdata or model.cells
    first, *others = model.formula.levels[variable]
    out = []
    for g in model.formula.levels[by] if by else [None]:
        keep = data.levels[by] == g if by else np.ones(len(data.n), bool)
        if not keep.any():
            continue
        at = lambda v: _mean(model, {k: x[keep] for k, x in data.levels.items()} | {variable: np.full(int(keep.sum()), v, object)}, data.n[keep])  # noqa: B023, E731
        base, grad = at(first)
        for v in others:
            value, own = at(v)
            out.append(({"by": g} if by else {}) | {"contrast": f"{v} - {first}"} | _row(value - base, own - grad, cov, level))
    return out


def odds_ratios(v: Robust, level: float = 0.95) -> list[dict]:
    return [{"term": t["term"], "odds_ratio": float(np.exp(t["estimate"])), "low": float(np.exp(t["estimate"] - t_quantile(level, t["df"]) * t["se"])), "high": float(np.exp(t["estimate"] + t_quantile(level, t["df"]) * t["se"])), "p": t["p"]} for t in coefficient_tests(v)]


def cell_predictions(model: Fit, cov: np.ndarray, variable: str, level: float = 0.95) -> list[dict]:
    """Predicted probability at each level of the only variable, with delta-method errors and an interval from the logit scale."""
    z, out = normal_quantile(level), []
    for v in model.formula.levels[variable]:
        x = model.formula.matrix({variable: np.array([v], object)})[0]
        eta, se = float(x @ model.beta), float(np.sqrt(x @ cov @ x))
        p = 1 / (1 + np.exp(-eta))
        out.append({"level": v, "probability": float(p), "se": float(p * (1 - p) * se), "low": float(1 / (1 + np.exp(-eta + z * se))), "high": float(1 / (1 + np.exp(-eta - z * se)))})
    return out


def pairwise(v: Robust, variable: str) -> list[dict]:
    """All differences of levels on the logit scale, p values adjusted by Holm."""
    f, out = v.fit.formula, []
    row = lambda level: f.matrix({k: np.array([level if k == variable else f.levels[k][0]], object) for k in f.factors})[0]
    for a, b in combinations(f.levels[variable], 2):
        c = row(b) - row(a)
        se, df = float(np.sqrt(c @ v.cov @ c)), v.df(c)
        out.append({"contrast": f"{b} - {a}", "estimate": float(c @ v.fit.beta), "se": se, "df": df, "p": t_two_sided(float(c @ v.fit.beta) / se, df) if se else float("nan")})
    return [r | {"p_holm": p} for r, p in zip(out, holm([r["p"] for r in out]), strict=True)]


def link_test(model: Fit) -> list[dict]:
    """Refits on the linear predictor and its square; a square that matters speaks against the link. t tests with Pearson dispersion."""
    eta = model.x @ model.beta
    x = np.column_stack([np.ones(len(eta)), eta, eta**2])
    c, beta = model.cells, np.array([0.0, 1.0, 0.0])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.lstsq(x.T @ (x * (c.n * mu * (1 - mu))[:, None]), x.T @ (c.s - c.n * mu), rcond=None)[0]
        beta = beta + step
        if np.abs(step).max() < 1e-12:
            break
    mu = 1 / (1 + np.exp(-x @ beta))
    df = model.n - 3
    phi = float(((c.q - 2 * mu * c.s + c.n * mu**2) / (mu * (1 - mu))).sum() / df)
    cov = phi * np.linalg.pinv(x.T @ (x * (c.n * mu * (1 - mu))[:, None]))
    return [{"term": t, "estimate": float(b), "se": float(np.sqrt(v)), "p": t_two_sided(float(b / np.sqrt(v)), df) if v > 0 else float("nan")} for t, b, v in zip(("(Intercept)", "hat", "hat2"), beta, np.diag(cov), strict=True)]


def leave_one_out(cells: Cells, formula: Formula, use) -> list[dict]:
    """use(fit) gives {name: value}; refits without each cluster, by dropping its cells, and returns the range of each value."""
    runs: dict[str, list] = {}
    for g in dict.fromkeys(cells.cluster):
        for name, value in use(fit(cells.without(g), formula)).items():
            runs.setdefault(name, []).append((value, g))
    return [{"name": k, "low": min(v)[0], "low_without": min(v)[1], "high": max(v)[0], "high_without": max(v)[1]} for k, v in runs.items()]


def observed_and_predicted(model: Fit, by: list[str]) -> list[dict]:
    """Mean outcome and mean prediction of each combination of levels."""
    keys = list(zip(*(model.cells.levels[b] for b in by), strict=True))
    out = []
    for k in dict.fromkeys(keys):
        at = np.array([x == k for x in keys])
        n = model.cells.n[at]
        out.append(dict(zip(by, k, strict=True)) | {"n": float(n.sum()), "observed": float(model.cells.s[at].sum() / n.sum()), "predicted": float((n * model.mu[at]).sum() / n.sum())})
    return out
