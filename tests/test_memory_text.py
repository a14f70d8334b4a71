"""What tasks hold does not grow with the rows of their input: texts."""

import random
import tracemalloc
import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F

from reachforge.functions import automaton, text


def test_texts_are_folded_and_searched_in_slices(spark, monkeypatch):
    r = random.Random(4)
    texts = [None, "", *["".join(r.choice(["aB", "ß", "ﬁ", "é", "Ｑ", "İ", "b"]) for _ in range(r.randrange(12))) for _ in range(300)]]
    folded = lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold()
    for most in (1, 40, 10**6):
        parts = list(text.slices(pa.array(texts), most))
        assert [x for p in parts for x in p.to_pylist()] == texts
        assert all(p.nbytes and (len(p) == 1 or sum(len((x or "").encode()) for x in p.to_pylist()) <= most) for p in parts)
        monkeypatch.setattr(text, "SLICE_BYTES", most)
        assert text.fold_texts(pa.array(texts)).to_pylist() == [folded(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", text.nfkc_casefold(F.col("t")).alias("f"), automaton.first_of([["b", "ab"], ["ab"]])(F.col("t")).alias("at"))
    for x in df.collect():
        assert x.f == folded(x.t) and x["at"] == [next((k for k, p in enumerate(ps) if p in (x.t or "")), -1) for ps in (["b", "ab"], ["ab"])]


def test_folding_holds_a_slice_beside_its_result():
    texts = pa.array([f"{k} " + "aé" * 1000 for k in range(5000)])
    tracemalloc.start()
    text.fold_texts(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6_000_000  # as Python strings the texts are 10 MB and their folded copies as much
