"""Stratified samples against sorting in memory."""

import random
from hashlib import sha256

import pytest

from reachforge.operators import audit


def brute(rows, per_cell, target, seed):
    """rows: (id, cell, other)."""
    best = {}
    low = lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:])  # noqa: E731  nulls first
    for r in rows:
        if r[0] not in best or low(r) < low(best[r[0]]):
            best[r[0]] = r
    order = lambda i: sha256("|".join([str(i), str(seed)] if i is not None else [str(seed)]).encode()).hexdigest()
    ranked = sorted(best.values(), key=lambda r: order(r[0]))
    seen, first, rest = {}, [], []
    for r in ranked:
        seen[r[1]] = seen.get(r[1], 0) + 1
        (first if seen[r[1]] <= per_cell else rest).append(r)
    first.sort(key=lambda r: (r[1] is not None, r[1] or "", order(r[0])))
    return (first + rest)[:target]


@pytest.mark.parametrize("kind", ["unique", "repeated", "in several cells"])
def test_sample_equals_sorting(spark, kind):
    r = random.Random(7)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), r.choice([None, 1, 2])) for i in range(400)] + [(9999, "rare", 1)]
    if kind != "unique":
        rows += [(i, c, 5) for i, c, _ in r.choices(rows, k=300)]
    if kind == "in several cells":
        rows += [(i, r.choice("abz"), r.choice([0, 9])) for i in range(0, 400, 3)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "i long, cell string, x int").repartition(5)
    for per_cell, target in ((2, 30), (3, 5), (50, 600), (1, 1)):
        got = audit.stratified_sample(df, "i", ["cell"], per_cell, target, seed=4)
        assert got.columns == ["i", "cell", "x"] and [tuple(x) for x in got.collect()] == brute(rows, per_cell, target, 4)


def test_a_task_hands_on_a_bounded_number_of_rows(spark):
    df = spark.range(0, 20_000, 1, 4).selectExpr("sha2(CAST(id AS STRING), 256) AS o", "CAST(id % 3 AS STRING) AS cell")
    assert audit.least_by_cell(df, "o", "cell", 5, 10).count() <= 3 * 5 + 10 + 3 * 5
    assert audit.least_by_cell(df.where("false"), "o", "cell", 5, 10).count() == 0
