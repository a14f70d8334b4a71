"""Decontamination: blocks of the benchmark, equal items, and texts with very many places of seeds."""

import random
from time import perf_counter

import pytest
from pyspark.sql import functions as F

from reachforge.llm import decontaminate


def plain(df):
    return sorted((str(x.doc_id), x.contaminated, tuple(map(str, x.items)), round(x.max_coverage, 9)) for x in df.collect())


def tables(spark):
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    items = [(k % 30 if k % 7 else None, " ".join(r.choices(words, k=r.choice([5, 8, 12, 20])))) for k in range(60)]
    items += items[:10] + [(99, None), (98, ""), (97, "one two three"), (96, items[3][1].upper())]
    docs = []
    for i in range(80):
        parts = [r.choice(items)[1] or "" for _ in range(r.randrange(4))]
        parts = [" ".join(p.split()[: r.randrange(3, 21)]) for p in parts]
        docs.append((i % 50 if i % 9 else None, " ".join([*r.choices(words, k=10), *parts])))
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit("own")), spark.createDataFrame(items, "item_id long, text string")


def test_verdicts_do_not_depend_on_blocks_nor_python_nodes_on_the_benchmark(spark):
    docs, bench = tables(spark)
    one = decontaminate.leak_report(docs, bench)
    kept = sorted((str(x.doc_id), x.text) for x in decontaminate.drop_leaks(docs, bench).collect())
    assert one.where("contaminated").count() > 10 and len(kept) == docs.count() - one.where("contaminated").count()
    for size in (2000, 400):
        assert decontaminate.blocks(bench, size)[0] > 1
        many = decontaminate.leak_report(docs, bench, block_chars=size)
        assert plain(many) == plain(one)
        assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        assert sorted((str(x.doc_id), x.text) for x in decontaminate.drop_leaks(docs, bench, block_chars=size).collect()) == kept


def test_equal_items_are_tiled_once():
    item = " ".join(f"t{i}" for i in range(40))
    one, many = decontaminate.Items([(1, item)]), decontaminate.Items([(i, item) for i in range(1000)])
    texts = [f"own {k} " + item for k in range(20)]
    start = perf_counter()
    got = many.leaks(texts)
    assert (perf_counter() - start) / len(texts) < 0.1
    assert [[i for i, _ in g] for g in got] == [list(range(1000))] * 20 and {c for g in got for _, c in g} == {one.leaks(texts)[0][0][1]}


@pytest.mark.parametrize("places", [1, 7, 100, 10_000])
def test_places_within_one_text_are_taken_by_ranges_of_items(monkeypatch, places):
    r = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    items = decontaminate.Items([(k, " ".join(r.choices(words, k=r.choice([6, 9, 14])))) for k in range(50)], seed=3)
    texts = [" ".join(r.choices(words, k=n)) for n in (5, 40, 400, 3)] + [""]
    want = items.leaks(texts)
    monkeypatch.setattr(decontaminate, "PLACES", places)
    assert items.leaks(texts) == want and sum(map(len, want)) > 10
