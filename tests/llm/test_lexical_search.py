"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reachforge.llm import lexical_search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(PATTERN, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    count, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = Counter()
    for item, text in set(items):
        scores = []
        for i, bag in bags:
            m = 25 + (75 * sum(bag.values()) * count) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms(text) if bag[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out.update((item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k]))
    return out


def corpus(seed, n):
    r = random.Random(seed)
    words = [[f"{chr(97 + lang)}{i}é" if i % 7 == 0 else f"{chr(97 + lang)}W{i}" for i in range(150)] for lang in range(4)]
    texts = [" ".join(r.choices(words[k % 4], k=r.choice([3, 20, 60]), weights=[1 / (i + 1) for i in range(150)])) for k in range(n)]
    texts += [texts[5]] * (n // 3) + [None, "", " .,;", "x" * 5000, "\x00\x7f", "日本 日本", "Ab-aB_ab", "same", "same", "same"]
    items = [(k, t) for k, t in enumerate([*r.sample(texts[:n], 12), texts[5], None, "", "...", "nowhere", "same", "日本", "AB ab ab", texts[7].upper() + " " + texts[8]])]
    return texts, items


@pytest.mark.parametrize(("size", "sample"), [(1024, 4096), (8, 4096), (16, 100)])
def test_search_equals_brute_force(spark, monkeypatch, size, sample):
    texts, items = corpus(size, 300)
    monkeypatch.setattr(lexical_search.shards, "__defaults__", (size,))
    monkeypatch.setattr(lexical_search.fit_order, "__defaults__", (sample,))
    docs = [(k * 7 % 1000, t) for k, t in enumerate(texts)] + [(None, "same"), (None, "AB ab"), (3, "same"), (3, "same")]
    items += [(None, "same"), (0, "same"), items[1], items[1]]
    df = spark.createDataFrame(docs, DOCS).repartition(3).select("*", *[F.lit("own").alias(c) for c in ("item", "score", "terms", "leaf")])
    got = lexical_search.search(df, spark.createDataFrame(items, ITEMS).withColumn("rank", F.lit("own")))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(x) for x in got.collect()) == brute(docs, items)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    texts, items = corpus(1, 60)
    monkeypatch.setattr(lexical_search, "BLOCK", 700)
    docs = list(enumerate(texts))
    got = lexical_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), 3)
    assert Counter(tuple(x) for x in got.collect()) == brute(docs, items, 3)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("false"), items.where("false")), (docs, spark.createDataFrame([(1, None), (2, "-")], ITEMS)), (spark.createDataFrame([(1, None), (2, " ")], DOCS), items)):
        assert lexical_search.search(d, i).count() == 0


def test_halves_part_languages_and_bring_like_documents_together(spark):
    texts, _ = corpus(9, 400)
    sketches = [np.unique(lexical_search.terms([t])[0]) for t in texts[:400]]
    order = lexical_search.bisect(sketches)
    rows = lexical_search.ordered(spark.createDataFrame(list(enumerate(texts[:400])), DOCS), order, np.zeros(0, np.uint64)).collect()
    leaves = Counter((r.leaf, r.doc_id % 4) for r in rows)
    alone = sum(max(leaves[leaf, lang] for lang in range(4)) for leaf in {r.leaf for r in rows})
    assert order.depth >= 2 and alone > 0.9 * len(rows)


def test_shards_whose_bound_is_too_low_are_passed_over(spark, monkeypatch):
    texts, items = corpus(2, 400)
    seen = []
    add = lexical_search.Best.add
    monkeypatch.setattr(lexical_search.Best, "add", lambda self, item, *rest: (seen.append(item), add(self, item, *rest))[1])
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).coalesce(1)
    block = lexical_search.Items([items[0]])
    rows = lexical_search.ordered(docs, lexical_search.fit_order(docs), block.vocabulary)
    index = lexical_search.shards(rows, 400, 10_000, 16).toArrow()
    block.weigh(400, {})
    run = {}

    class Frame:  # hands the task's function out, to run it here
        sparkSession = spark
        mapInArrow = staticmethod(lambda f, schema: run.update(f=f))

    lexical_search.visit(Frame, block, np.zeros(1, np.int64), 3, but={})
    list(run["f"](iter(index.to_batches())))
    assert 0 < len(seen) < index.num_rows / 2
