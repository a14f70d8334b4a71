"""Sets are called by as few bytes of their hash as tell them apart; results are the same whatever the number."""

import random

import pytest

from reachforge.llm import ngram_join


@pytest.mark.parametrize("sizes", [(8, 16), (1, 3, 16), (1, 16)])
def test_short_names_fall_back_to_longer_ones(spark, monkeypatch, sizes):
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(r.choices(words, k=r.choice([6, 30, 60]))) for _ in range(60)]
    texts = base + [t + " tail" for t in base[:30]] + base[:10] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, ngram_join.similar_components(df, 4, 85).collect()))
    monkeypatch.setattr(ngram_join, "ID_BYTES", sizes)
    join = ngram_join.Join(df, 4, 85)
    assert join.id_bytes == (8 if 8 in sizes else 3 if 3 in sizes else 16)
    assert sorted(map(tuple, join.report().collect())) == want and len({c for _, _, c in want}) < len(texts)
