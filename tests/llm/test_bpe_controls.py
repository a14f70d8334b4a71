"""Control characters, marks and odd spaces in BPE encoding, against the library."""

import hashlib
import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reachforge.llm import bpe_codec

LIB = Tokenizer.from_file(P.path("word_bpe_49k.json"))
CODEC = bpe_codec.Codec(P.path("word_bpe_49k.json"))
LOW = [chr(c) for c in range(0x250)]


def coded(texts):
    offsets, ids = CODEC.encode(texts)
    back = CODEC.decode(offsets, ids)
    return [(ids[offsets[k] : offsets[k + 1]].tolist(), back[k].decode()) for k in range(len(texts))]


def want(t):
    ids = LIB.encode(t, add_special_tokens=False).ids
    return ids, LIB.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("form", ["{0}", "a{0}b", "{0}{0}", "a {0} b", "{0}a", "a{0}", "a{0}{0}b", "1{0}2", "x{0}'s", "é{0}ñ", "-{0}-"])
def test_every_low_character(form):
    texts = [form.format(c) for c in LOW]
    assert coded(texts) == [want(t) for t in texts]


@given(st.lists(st.text(st.sampled_from(LOW), max_size=12), max_size=6))
@settings(max_examples=300, deadline=None)
def test_mixtures_of_low_characters(texts):
    assert coded(texts) == [want(t) for t in texts]


def test_documents_with_control_characters_pass_the_query_and_the_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(1)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(400)]
    odd = " ".join(w + chr(k % 32) + chr(127) if k % 5 == 0 else w for k, w in enumerate(words[:120]))
    long = " ".join(r.choice(words) + chr(r.randrange(0x250)) for _ in range(40_000))
    rows = [(0, odd, "en", "s", len(odd)), (1, "a\x1bb \x00\x7f", "en", "s", 6), (2, long, None, None, None), (3, " ".join(words[200:300]), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x.doc_id: x for x in bpe_codec.encode_documents(df, keep_ids=True).collect()}
    for i, t, *_ in rows:
        ids, text = want(t)
        assert list(got[i].ids) == ids and got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "x\x1by " * 9)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {x.doc_id: list(x.ids) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {0, 3} <= set(kept) and kept[0] == want(odd)[0]
