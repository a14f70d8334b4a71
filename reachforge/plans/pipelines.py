"""The three entry points, wired: collect and reconcile, classify and lock, fingerprint and collapse; and the model runner."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.dates import date_only
from ..functions.jsonlist import parse
from ..functions.text import nfkc_casefold, stable_signature
from ..operators import configurations, eligibility_rules, lock, reconcile, rules, temporal
from ..stats import effects, sandwich
from ..stats.cells import Cells, cell_table, collect_cells
from ..stats.design import Formula
from ..stats.glm import Fit, fit


def consolidate(versions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return reconcile.reconcile(versions)


@dataclass
class Eligibility:
    classified: DataFrame
    kept: DataFrame
    review: DataFrame
    locked: DataFrame
    ledger: DataFrame


def classify_and_lock(rows: DataFrame, start: str, end: str, decisions: DataFrame) -> Eligibility:
    """Rows that start inside the window, classified by the rule table; excluded ones and manual decisions leave, and enter the ledger."""
    inside = temporal.eligible(rows.withColumn("_start", date_only(F.col(S.START))), "_start", start, end).drop("_start")
    lists = {c: parse(F.col(c), "drop") for c in S.CREATIVE}
    texts = inside.withColumns({f"_l_{c}": x for c, x in lists.items()})
    c = rules.classify(texts, [f"_l_{c}" for c in S.CREATIVE], eligibility_rules.SIGNALS, eligibility_rules.RULES, eligibility_rules.DEFAULT, eligibility_rules.EMPTY)
    c = c.withColumn("matched_field", F.regexp_replace("matched_field", "^_l_", "")).select(*inside.columns, *S.CLASSIFIED[len(S.RAW) :])
    kept, review, out = rules.route(c)
    manual = lock.noncommercial(decisions)
    return Eligibility(c, kept, review, lock.lock(c, out, manual), lock.ledger(c, out, manual))


def fingerprint(rows: DataFrame, retailers: DataFrame) -> DataFrame:
    """Adds page_id and the stable signature."""
    lists = [parse(F.col(c), "blank") for c in S.CREATIVE]
    return lock.with_page_id(rows, retailers).withColumn("creative_signature_hash", stable_signature(F.col("page_id"), lists, nfkc_casefold))


def analysis_ready(rows: DataFrame, retailers: DataFrame) -> DataFrame:
    return configurations.derive(fingerprint(rows, retailers)).select(*S.RAW, *S.DERIVED)


def configuration_level(rows: DataFrame, retailers: DataFrame) -> DataFrame:
    return configurations.configurations(analysis_ready(rows, retailers))


@dataclass
class Model:
    """A share model with its robust covariance; everything below works on its cells."""

    cells: Cells
    formula: Formula
    fit: Fit
    robust: sandwich.Robust

    def coefficients(self) -> list[dict]:
        return sandwich.coefficient_tests(self.robust)

    def joint(self, term: str) -> dict:
        return sandwich.wald(self.robust, self.fit.formula.picks(term))

    def predictions(self, variable: str, by: str | None = None, newdata: Cells | None = None) -> list[dict]:
        return effects.average_predictions(self.fit, self.robust.cov, variable, by, newdata)

    def contrasts(self, variable: str, by: str | None = None, newdata: Cells | None = None) -> list[dict]:
        return effects.average_contrasts(self.fit, self.robust.cov, variable, by, newdata)

    def leave_one_out(self, variable: str) -> list[dict]:
        import numpy as np

        def use(f: Fit) -> dict:
            return {r["contrast"]: r["estimate"] for r in effects.average_contrasts(f, np.zeros((len(f.beta),) * 2), variable)}

        return effects.leave_one_out(self.cells, self.formula, use)


def share_model(df: DataFrame, y: Column, cluster: str, formula: Formula, where: Column | None = None, weight: Column | None = None, kind: str = "CR2", link: str = "logit") -> Model:
    """Fractional logit of a share, or of a 0/1 outcome. The scan and the grouping are distributed; only cells reach the driver. where: the sample, such as a reach threshold. A weight that varies within cells keeps estimates exact; CR2 then treats a cell as one row of its total weight."""
    rows = df if where is None else df.where(where)
    cells = collect_cells(cell_table(rows, y, cluster, formula.factors, weight), formula.factors)
    f = fit(cells, formula, link)
    return Model(cells, formula, f, sandwich.robust(f, kind))


def sample_where(levels: dict[str, list[str]]) -> Column:
    """Rows whose factors have one of the given levels."""
    out = F.lit(True)
    for c, v in levels.items():
        out = out & F.col(c).isin(*v)
    return out
