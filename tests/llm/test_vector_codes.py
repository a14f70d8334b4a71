"""Vector codes against brute force."""

import math
import random
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachforge.llm import vector_codes

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """By the definition, in Python's integers."""
    good = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) if good else 0
    good = [r for r in good if len(r[1]) == width]
    whole = [[math.floor(4096 * float(np.float32(x))) for x in v] + [0] * (-width % parts) for _, v, _ in good]
    size = (width + -width % parts) // parts
    cut = [[v[p * size : (p + 1) * size] for v in whole] for p in range(parts)]
    books = [[list(x) for x in cut[p][:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda p: [min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e)) for x in cut[p]]
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for x, e in zip(cut[p], assign(p), strict=True):
                own[e].append(x)
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    last = [assign(p) for p in range(parts)]
    error = [sum(far(cut[p][k], books[p][last[p][k]]) for p in range(parts)) for k in range(len(good))]
    total = Counter()
    for (_, _, label), e in zip(good, error, strict=True):
        total[label] += e
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, "".join(f"{last[p][k]:02x}" for p in range(parts)), error[k], total[label], digest) for k, (i, _, label) in enumerate(good))


def some(n, width, values, seed=1):
    r = random.Random(seed)
    return [(i, [r.choice(values) for _ in range(width)], r.choice([None, 1, 2])) for i in range(n)]


ODD = [(500, None, 1), (501, [], 1), (502, [1.0, None] * 8, 1), (503, [float("nan")] * 16, 2), (504, [float("inf")] * 16, None), (505, [1.0] * 8, 3), (None, [0.25] * 16, None), (None, [-0.25] * 16, 7), (3, [0.5] * 16, 1), (3, [0.5] * 16, 1)]


@pytest.mark.parametrize(
    "rows",
    [
        some(300, 16, [-0.5, -0.25, 0.0, 0.25, 0.5]) + ODD,  # many ties and equal entries
        some(200, 16, [k / 1000 for k in range(-999, 999)], 2),
        some(60, 21, [k / 1000 for k in range(-9, 9)], 3),  # no multiple of eight
        some(7, 8, [0.1, -0.1], 4),  # fewer vectors than entries
        some(80, 16, [1e6, -3e7, 0.5, 0.001], 5),  # beyond 64 bits
        [(i, [float(i % 2)] * 8, 0) for i in range(40)],
    ],
    ids=["ties", "plain", "width", "few", "large", "two values"],
)
def test_compress_equals_brute_force(spark, rows):
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, ROWS).repartition(3).select("*", *[F.lit("own").alias(c) for c in ("row", "code", "error", "_vector")])
    got = vector_codes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = brute(rows)
    long = lambda x: x if x < 1 << 63 else None
    assert Counter(tuple(x) for x in got.collect()) == Counter({(i, c, long(e), long(t), d): n for (i, c, e, t, d), n in want.items()})


def test_tree_finds_the_nearest_of_equal_bounds():
    r = np.random.default_rng(0)
    for _ in range(60):
        entries = r.integers(-3, 4, (16, 3)).tolist()
        points = r.integers(-4, 5, (200, 3))
        best, dist = vector_codes.Tree.over(entries).nearest(points)
        far = ((points[:, None, :] - np.array(entries)[None]) ** 2).sum(2)
        assert (best == far.argmin(1)).all() and (dist == far.min(1)).all()


def test_codes_stand_for_vectors(spark):
    df = spark.createDataFrame(some(100, 16, [-0.5, 0.25, 0.5]), ROWS)
    books = vector_codes.train(df, entries=100, rounds=1)
    back = vector_codes.decode(vector_codes.encode(df, books), books).select("row.embedding", "vector", "error").collect()
    assert len(back) == 100 and all(x.embedding == x.vector and x.error == 0 for x in back)


def test_empty_table_and_no_sound_row(spark):
    for rows in ([], [(1, None, 1), (2, [None], 1)]):
        got = vector_codes.compress(spark.createDataFrame(rows, ROWS))
        assert got.count() == 0 and dict(got.dtypes)["label_error"] == "bigint"
