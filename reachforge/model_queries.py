"""Queries of models and tests over the driver's tables. Designs that are saturated have closed forms, which their SQL computes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.pipelines import Model, share_model
from .queries import query, t
from .stats import effects, tests
from .stats.cells import cell_table, collect_cells
from .stats.design import Formula

FLAGS, STATUS = ["A", "N", "R"], ["F", "O"]
ONE, TWO = Formula(("flag",), {"flag": FLAGS}), Formula(("status",), {"status": STATUS})
BOTH = Formula(("flag", "status", "flag:status"), {"flag": FLAGS, "status": STATUS})
SQL_ROWS = "SELECT p_brand AS g, l_returnflag AS flag, l_linestatus AS status, l_discount * 10 AS y, l_quantity AS w, l_suppkey AS supplier FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_discount * 10 <= 1"


def rows(spark: SparkSession, d: str) -> DataFrame:
    li = t(spark, d, "lineitem").select("l_partkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), (F.col("l_discount") * 10).alias("y"), F.col("l_quantity").alias("w"), F.col("l_suppkey").alias("supplier"))
    return li.join(t(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("g")), "l_partkey").where("y <= 1")


def model(spark, d, formula: Formula, **more) -> Model:
    return share_model(rows(spark, d), F.col("y"), "g", formula, **more)


def table(spark: SparkSession, found: list[dict], columns: dict[str, str]) -> DataFrame:
    """Rows of a fitted model; columns: new name to the result's name. Numbers to 6 decimals."""
    show = lambda v: round(float(v), 6) if isinstance(v, (float, np.floating)) else v
    kinds = ", ".join(f"{k} {'string' if isinstance(found[0][v], str) else 'boolean' if isinstance(found[0][v], bool) else 'double'}" for k, v in columns.items())
    return spark.createDataFrame([tuple(show(r[v]) for v in columns.values()) for r in found], kinds)


#: By level k: mean m, variance function v, n; by cluster and level: n, residual sum r; u: the cluster's score over the information.
SQL_CELLS = f"""WITH x AS ({SQL_ROWS}), k AS (SELECT LEVEL AS k, avg(y) AS m, avg(y) * (1 - avg(y)) AS v, count(*) AS n FROM x GROUP BY LEVEL),
 c AS (SELECT x.g, k.k, count(*) AS nc, any_value(k.n) AS n, any_value(k.v) AS v, sum(y - m) AS r FROM x JOIN k ON k.k = x.LEVEL GROUP BY x.g, k.k)"""
#: Contrasts of two levels on the logit scale: CR2 variance, and Satterthwaite's degrees of freedom from the matrix of clusters.
SQL_CONTRASTS = SQL_CELLS + """, pairs AS (SELECT a.k AS a, b.k AS b, ln(b.m / (1 - b.m)) - ln(a.m / (1 - a.m)) AS estimate FROM k a JOIN k b ON a.k < b.k),
 s AS (SELECT a, b, estimate, c.g, k, CASE WHEN c.k = b THEN 1.0 ELSE -1.0 END * r / sqrt(1 - CAST(nc AS DOUBLE) / n) / (n * v) AS u, CASE WHEN c.k = b THEN 1.0 ELSE -1.0 END * sqrt(nc * v) / sqrt(1 - CAST(nc AS DOUBLE) / n) / (n * v) AS p, sqrt(CAST(nc AS DOUBLE) / n) AS q FROM pairs JOIN c ON c.k IN (a, b)),
 var AS (SELECT a, b, any_value(estimate) AS estimate, sqrt(sum(u * u)) AS se FROM (SELECT a, b, g, any_value(estimate) AS estimate, sum(u) AS u FROM s GROUP BY ALL) GROUP BY a, b),
 kk AS (SELECT x.a, x.b, x.g AS g1, y.g AS g2, sum(x.p * y.p * (CASE WHEN x.g = y.g THEN 1.0 ELSE 0.0 END - x.q * y.q)) AS z FROM s x JOIN s y ON x.a = y.a AND x.b = y.b AND x.k = y.k GROUP BY ALL),
 dof AS (SELECT a, b, pow(sum(z) FILTER (g1 = g2), 2) / sum(z * z) AS df FROM kk GROUP BY a, b)"""


def contrasts(level: str, select: str) -> str:
    return SQL_CONTRASTS.replace("LEVEL", level) + " " + select


@query(contrasts("flag", "SELECT 'flag=' || b AS term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(estimate / se, 6) AS t, round(df, 6) AS df FROM var JOIN dof USING (a, b) WHERE a = 'A'"))
def robust_coefficient_tests(spark, d):
    """CR2 standard errors with Satterthwaite degrees of freedom."""
    found = [r for r in model(spark, d, ONE).coefficients() if r["term"] != "(Intercept)"]
    return table(spark, found, {k: k for k in ("term", "estimate", "se", "t", "df")})


@query(contrasts("flag", "SELECT b || ' - ' || a AS contrast, round(estimate, 6) AS estimate, round(se, 6) AS se, round(df, 6) AS df FROM var JOIN dof USING (a, b)"))
def pairwise_contrasts(spark, d):
    return table(spark, effects.pairwise(model(spark, d, ONE).robust, "flag"), {k: k for k in ("contrast", "estimate", "se", "df")})


@query(contrasts("status", "SELECT round(pow(estimate / se, 2), 6) AS statistic, round(pow(estimate / se, 2), 6) AS f, round(df, 6) AS df2 FROM var JOIN dof USING (a, b)"))
def joint_wald_test(spark, d):
    return table(spark, [model(spark, d, TWO).joint("status")], {"statistic": "statistic", "f": "F", "df2": "df2"})


@query(contrasts("flag", "SELECT 'flag=' || b AS term, round(exp(estimate), 6) AS odds_ratio FROM var WHERE a = 'A'"))
def odds_ratios(spark, d):
    return table(spark, [r for r in effects.odds_ratios(model(spark, d, ONE).robust) if r["term"] != "(Intercept)"], {"term": "term", "odds_ratio": "odds_ratio"})


@query(SQL_CELLS.replace("LEVEL", "flag") + """, e AS (SELECT k, m, v, sqrt(sum(pow(r / sqrt(1 - CAST(nc AS DOUBLE) / c.n) / (c.n * c.v), 2))) AS se FROM c JOIN (SELECT k, m FROM k) USING (k) GROUP BY k, m, v)
 SELECT k AS level, round(m, 6) AS probability, round(v * se, 6) AS se, round(1 / (1 + exp(-ln(m / (1 - m)) + 1.959963984540054 * se)), 6) AS low, round(1 / (1 + exp(-ln(m / (1 - m)) - 1.959963984540054 * se)), 6) AS high FROM e""")
def predicted_probabilities(spark, d):
    m = model(spark, d, ONE)
    return table(spark, effects.cell_predictions(m.fit, m.robust.cov, "flag"), {k: k for k in ("level", "probability", "se", "low", "high")})


@query(SQL_CELLS.replace("LEVEL", "flag") + """, s AS (SELECT c.k, sum(pow(r / (n * v), 2)) AS v FROM c GROUP BY c.k), z AS (SELECT count(DISTINCT g) AS g, count(*) AS n FROM x)
 SELECT k AS level, round(sqrt(s.v * z.g * (z.n - 1) / ((z.g - 1) * (z.n - 3.0))), 6) AS se FROM s, z""")
def cr1s_errors(spark, d):
    """Standard errors of the levels' logits by the scaled plain sandwich."""
    v = model(spark, d, ONE, kind="CR1S").robust
    row = lambda k: v.fit.formula.matrix({"flag": np.array([k], object)})[0]
    return table(spark, [{"level": k, "se": float(np.sqrt(row(k) @ v.cov @ row(k)))} for k in FLAGS], {"level": "level", "se": "se"})


SQL_MEANS = f"SELECT flag, status, avg(y) AS m, count(*) AS n FROM ({SQL_ROWS}) GROUP BY ALL"


@query(f"SELECT status AS by_status, flag AS level, round(m, 6) AS estimate FROM ({SQL_MEANS})")
def predictions_by_group(spark, d):
    return table(spark, model(spark, d, BOTH).predictions("flag", "status"), {"by_status": "by", "level": "level", "estimate": "estimate"})


@query(f"SELECT b.status AS by_status, b.flag || ' - ' || a.flag AS contrast, round(b.m - a.m, 6) AS estimate FROM ({SQL_MEANS}) a JOIN ({SQL_MEANS}) b ON a.status = b.status AND a.flag = 'A' AND b.flag != 'A'")
def contrasts_by_group(spark, d):
    return table(spark, model(spark, d, BOTH).contrasts("flag", "status"), {"by_status": "by", "contrast": "contrast", "estimate": "estimate"})


@query(f"SELECT flag AS level, round(sum(m * w) / sum(w), 6) AS estimate FROM ({SQL_MEANS}) JOIN (SELECT status, count(*) AS w FROM ({SQL_ROWS}) WHERE supplier % 2 = 0 GROUP BY status) USING (status) GROUP BY flag")
def standardised_predictions(spark, d):
    """Predictions over the mix of another sample."""
    other = collect_cells(cell_table(rows(spark, d).where("supplier % 2 = 0"), F.col("y"), "g", BOTH.factors), BOTH.factors)
    return table(spark, model(spark, d, BOTH).predictions("flag", newdata=other), {"level": "level", "estimate": "estimate"})


@query(f"SELECT flag, status, CAST(n AS DOUBLE) AS n, round(m, 6) AS observed, round(m, 6) AS predicted FROM ({SQL_MEANS})")
def observed_and_predicted(spark, d):
    return table(spark, effects.observed_and_predicted(model(spark, d, BOTH).fit, ["flag", "status"]), {k: k for k in ("flag", "status", "n", "observed", "predicted")})


@query(f"SELECT flag AS level, round(avg(y), 6) AS estimate FROM ({SQL_ROWS}) GROUP BY flag")
def least_squares_predictions(spark, d):
    return table(spark, model(spark, d, ONE, link="identity").predictions("flag"), {"level": "level", "estimate": "estimate"})


@query(f"SELECT flag AS level, round(sum(y * w) / sum(w), 6) AS estimate FROM ({SQL_ROWS}) GROUP BY flag")
def weighted_predictions(spark, d):
    return table(spark, model(spark, d, ONE, weight=F.col("w")).predictions("flag"), {"level": "level", "estimate": "estimate"})


@query(f"SELECT flag AS level, round(avg(CASE WHEN y > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS estimate, true AS converged FROM ({SQL_ROWS}) WHERE w >= 10 GROUP BY flag")
def binary_outcome_above_threshold(spark, d):
    """A binomial logit of rows above a threshold, with the fit's own flag of convergence."""
    m = share_model(rows(spark, d), (F.col("y") > 0.5).cast("double"), "g", ONE, where=F.col("w") >= 10)
    return table(spark, [r | {"converged": m.fit.converged} for r in m.predictions("flag")], {"level": "level", "estimate": "estimate", "converged": "converged"})


@query(f"""WITH x AS ({SQL_ROWS}), o AS (SELECT DISTINCT g AS o FROM x), m AS (SELECT o, flag, avg(y) AS m FROM x JOIN o ON x.g != o GROUP BY ALL), c AS (SELECT a.o, b.flag || ' - A' AS name, b.m - a.m AS e FROM m a JOIN m b ON a.o = b.o AND a.flag = 'A' AND b.flag != 'A')
 SELECT name, round(min(e), 6) AS low, arg_min(o, e) AS low_without, round(max(e), 6) AS high, arg_max(o, e) AS high_without FROM c GROUP BY name""")
def leave_one_out_range(spark, d):
    return table(spark, model(spark, d, ONE).leave_one_out("flag"), {k: k for k in ("name", "low", "low_without", "high", "high_without")})


@query(f"""WITH x AS ({SQL_ROWS}), m AS (SELECT flag, avg(y) AS m FROM x GROUP BY flag), e AS (SELECT flag, pow(y - m, 2) AS e FROM x JOIN m USING (flag)), a AS (SELECT avg(e) AS a, count(*) AS n FROM e), f AS (SELECT flag, avg(e) AS f FROM e GROUP BY flag)
 SELECT round(any_value(a.n) * sum(pow(f - a, 2)) / sum(pow(e - a, 2)), 6) AS statistic, 2.0::DOUBLE AS df, round((SELECT min(m) FROM m), 6) AS fitted_low, round((SELECT max(m) FROM m), 6) AS fitted_high FROM e JOIN f USING (flag), a""")
def breusch_pagan_test(spark, d):
    table_ = cell_table(rows(spark, d), F.col("y"), "g", ["flag"])
    cells = collect_cells(table_, ["flag"])
    power = rows(spark, d).groupBy(F.col("g").alias("cluster"), "flag").agg(F.sum(F.pow("y", F.lit(3))).alias("third"), F.sum(F.pow("y", F.lit(4))).alias("fourth")).orderBy("cluster", "flag").collect()  # a row a cell
    r = tests.breusch_pagan(cells, ONE, np.array([p["fourth"] for p in power]), np.array([p["third"] for p in power]))
    return table(spark, [r | {"df": float(r["df"])}], {k: k for k in ("statistic", "df", "fitted_low", "fitted_high")})


@query(f"""WITH m AS (SELECT supplier % 10 AS g, supplier % 3 AS k, avg(y) AS m FROM ({SQL_ROWS}) GROUP BY ALL), r AS (SELECT *, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY m) AS tied FROM m), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(tied * tied - 1) AS ties FROM r)
 SELECT round((12 / (n * (n + 1)) * (SELECT sum(s * s / c) FROM (SELECT sum(r) AS s, count(*) AS c FROM r GROUP BY k)) - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 6) AS statistic, 2.0::DOUBLE AS df FROM n""")
def kruskal_wallis_of_means(spark, d):
    means = rows(spark, d).groupBy((F.col("supplier") % 10).alias("g"), (F.col("supplier") % 3).alias("k")).agg(F.avg("y").alias("m")).orderBy("g", "k").collect()  # 30 rows
    r = tests.kruskal_wallis([x["m"] for x in means], [str(x["k"]) for x in means])
    return table(spark, [r | {"df": float(r["df"])}], {"statistic": "statistic", "df": "df"})


@query()
def link_test(spark, d):
    m = model(spark, d, Formula(("flag", "status"), BOTH.levels))
    return table(spark, effects.link_test(m.fit), {k: k for k in ("term", "estimate", "se", "p")})




SQL_NATIONS = "SELECT c_nationkey, avg(CAST(c_acctbal > 4000 AS DOUBLE)) AS y, count(*) AS w FROM customer GROUP BY c_nationkey"


@query(f"""WITH r AS ({SQL_NATIONS}), m AS (SELECT sum(w * y) / sum(w) AS mu, CAST(sum(w) AS DOUBLE) AS t FROM r), a AS (SELECT w * (y - mu) AS u, w / t AS h, w / (1 - w / t) / (t * t) AS d, w * w / (1 - w / t) / (t * t * t) AS q, t FROM r, m),
 s AS (SELECT sum(u * u / (1 - h)) / any_value(t * t) AS v, sum(d - q) AS trace, sum(d * d) - 2 * sum(d * q) + sum(q) * sum(q) AS squares FROM a) SELECT '(Intercept)' AS term, round(mu, 9) AS estimate, round(sqrt(v), 9) AS se, round(mu / sqrt(v), 6) AS t, round(trace * trace / squares, 6) AS df FROM m, s""")
def weighted_cr2_of_a_mean(spark, d):
    """A weighted mean of nations, each a cluster of one row: weights as counts, CR2 and Satterthwaite degrees of freedom."""
    from .stats.weighted import weighted_model

    rows = t(spark, d, "customer").groupBy("c_nationkey").agg(F.avg((F.col("c_acctbal") > 4000).cast("double")).alias("y"), F.count(F.lit(1)).alias("w")).withColumn("all", F.lit("x"))
    found = weighted_model(rows, F.col("y"), "c_nationkey", Formula(("all",), {"all": ["x"]}), F.col("w"), link="identity").coefficients()
    return spark.createDataFrame([(r["term"], round(r["estimate"], 9), round(r["se"], 9), round(r["t"], 6), round(r["df"], 6)) for r in found], "term string, estimate double, se double, t double, df double")


SQL_SEGMENTS = "SELECT c_nationkey, c_custkey % 3 AS part, avg(CAST(c_acctbal > 4000 AS DOUBLE)) AS y, count(*) AS w FROM customer GROUP BY ALL"


@query(f"""WITH r AS (SELECT part, y, w, c_nationkey, sum(w) OVER (PARTITION BY part) AS t FROM ({SQL_SEGMENTS})), m AS (SELECT part, sum(w * y) / sum(w) AS mu FROM r GROUP BY part) SELECT 'part=' || CAST(m.part AS VARCHAR) AS term, round(ln(m.mu / (1 - m.mu)) - ln(b.mu / (1 - b.mu)), 6) AS estimate FROM m, (SELECT mu FROM m WHERE part = 0) b WHERE m.part > 0 UNION ALL SELECT '(Intercept)', round(ln(mu / (1 - mu)), 6) FROM m WHERE part = 0""")
def weighted_logit_estimates(spark, d):
    """A weighted logit of shares with weights that differ within cells."""
    from .stats.weighted import weighted_model

    rows = t(spark, d, "customer").groupBy("c_nationkey", (F.col("c_custkey") % 3).cast("string").alias("part")).agg(F.avg((F.col("c_acctbal") > 4000).cast("double")).alias("y"), F.count(F.lit(1)).alias("w"))
    found = weighted_model(rows, F.col("y"), "c_nationkey", Formula(("part",), {"part": ["0", "1", "2"]}), F.col("w")).coefficients()
    return spark.createDataFrame([(r["term"], round(r["estimate"], 6)) for r in found], "term string, estimate double")
