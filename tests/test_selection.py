"""Running sums, quantiles by counting and simulated p values against their definitions."""

import random
from math import comb, prod

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachforge.operators.audit import concentration, top_share
from reachforge.operators.running import with_running
from reachforge.stats import tests


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_running_sums_with_ties_across_the_bounds_of_ranges(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        r = random.Random(1)
        rows = [(f"n{i:03}", r.choice([5, 5, 5, 5, 7, 1])) for i in range(300)]
        got = concentration(spark.createDataFrame(rows, "name string, n long"), "name", "n")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
        want, running = [], 0
        for k, (name, n) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0]))):
            running += n
            want.append((name, n, k + 1, running, round(100.0 * running / sum(n for _, n in rows), 4)))
        assert [tuple(x) for x in got.orderBy("rank").collect()] == want
        assert top_share(spark.createDataFrame(rows, "name string, n long"), "name", "n").first()[0] == pytest.approx(round(700 / sum(n for _, n in rows), 4))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_running_sums_of_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([("a", None), ("b", 2), ("b", 2), (None, 3)], "k string, v long")
    got = with_running(df, [F.asc_nulls_last("k")], "v").orderBy("rank").collect()
    assert [(x.k, x.v, x["rank"], x.running, x.total) for x in got] == [("a", None, 1, 0, 7), ("b", 2, 2, 2, 7), ("b", 2, 3, 4, 7), (None, 3, 4, 7, 7)]
    assert with_running(df.where("false"), [F.asc("k")], "v").count() == 0


def test_quantiles_by_counting_equal_sorting(spark):
    r = random.Random(2)
    groups = {
        "plain": [r.gauss(0, 1) for _ in range(500)], "ties": [float(r.randrange(3)) for _ in range(400)], "one": [4.5], "two": [1.0, 2.0], "same": [7.0] * 50,
        "spread": [s * 10.0 ** r.randrange(-300, 300) for s in (-1, 1) for _ in range(60)], "huge": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324], None: [float(i) for i in range(100)],
    }
    rows = [(g, y) for g, ys in groups.items() for y in ys] + [("plain", None), ("none", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, y double").repartition(3)
    a = {x.g: x for x in tests.quantiles(df, F.col("y"), ["g"], held=0).collect()}
    b = {x.g: x for x in tests.quantiles(df, F.col("y"), ["g"]).collect()}
    assert set(a) == set(b) == set(groups)
    for g, ys in groups.items():
        assert [a[g][f"q{k}"] for k in (0, 25, 50, 75, 100)] == [b[g][f"q{k}"] for k in (0, 25, 50, 75, 100)], g
        assert a[g].q0 == min(ys) and a[g].q100 == max(ys) and (g == "huge" or a[g].q50 == pytest.approx(float(np.median(ys)), rel=1e-12))
    whole = tests.describe(df.where("g = 'plain'"), F.col("y"), [], held=0).first()
    assert whole["median"] == b["plain"].q50


def exact_p(table):
    """By all tables of two rows with the same margins."""
    t = np.array(table)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    stat, rows, cols = ((t - e) ** 2 / e).sum(), t.sum(1), t.sum(0)
    hit = 0
    for first in np.ndindex(*(cols + 1)):
        if sum(first) == rows[0]:
            x = np.array([first, cols - np.array(first)])
            if ((x - e) ** 2 / e).sum() >= stat - 1e-9:
                hit += prod(comb(int(c), int(k)) for c, k in zip(cols, first, strict=True))
    return hit / comb(int(t.sum()), int(rows[0]))


@pytest.mark.parametrize("table", [[[3, 1, 4], [1, 5, 2]], [[8, 2], [1, 9]], [[1, 0, 2, 3], [3, 2, 0, 1]]])
def test_simulated_p_agrees_with_the_exact_one_on_any_partitioning(spark, table):
    draws, want = 4000, exact_p(table)
    got = tests.chi_square_simulated(np.array(table), draws, 3, spark)
    assert abs(got - want) < 4 * (want * (1 - want) / draws) ** 0.5 + 1 / draws
    assert got == tests.chi_square_simulated(np.array(table), draws, 3) and got != tests.chi_square_simulated(np.array(table), draws, 4)
    rows = [(f"r{i}", f"c{j}") for i, r in enumerate(table) for j, n in enumerate(r) for _ in range(n)] + [(None, "c0"), ("r0", None)]
    found = tests.simulated_test(spark.createDataFrame(rows, "a string, b string"), "a", "b", draws, 3)
    assert found["p_simulated"] == got and found["statistic"] == pytest.approx(tests.chi_square(np.array(table))["statistic"])
