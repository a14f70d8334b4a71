"""What Python workers hold does not grow with the rows of a batch or with the words that they have met."""

import tracemalloc
from itertools import islice, product
from string import ascii_lowercase

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from reachforge.llm import bpe_codec, common, decontaminate, last_token

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", *[f"{k} " + "words of a text " * 200 for k in range(5000)]]


class Clean:
    """Items that are in no text."""

    def leaks(self, texts, coverage):
        return [[] for _ in texts]


@pytest.mark.parametrize("most", [1, 4000, 10**9])
def test_parts_are_the_rows_in_order(most):
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(TEXTS[:50])], ["doc_id", "text"])
    got = list(common.parts(batch, 1, most))
    assert pa.Table.from_batches(got).to_pylist() == batch.to_pylist()
    assert all(sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) < most for p in got)
    assert list(common.parts(batch.slice(0, 0), 1, most)) == []


@pytest.mark.parametrize("use", [
    lambda batch: sum(len(texts) for _, texts in bpe_codec.groups(batch)),
    lambda batch: len(decontaminate.leaks_of(batch, 1, Clean(), 0.5)),
])
def test_some_texts_of_a_batch_are_strings_at_a_time(use):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["doc_id", "text"])
    tracemalloc.start()
    rows = use(batch)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == len(TEXTS)
    assert most < 5_000_000  # all texts are 16 MB


def test_the_codec_keeps_a_bounded_table_of_words():
    codec = bpe_codec.Codec(PATH)
    words = [f"{a}{b}{c}{d}" for a, b, c, d in islice(product(ascii_lowercase, repeat=4), 160_000)]
    lib = Tokenizer.from_file(PATH)
    for start in range(0, len(words), 20_000):
        text = " ".join(words[start : start + 20_000])
        offsets, ids = codec.encode([text, words[0]])
        assert ids[: offsets[1]].tolist() == lib.encode(text, add_special_tokens=False).ids
        assert ids[offsets[1] :].tolist() == lib.encode(words[0], add_special_tokens=False).ids
        assert len(codec.number) <= 150_001 and codec.chars <= 3_200_000


def test_the_table_of_fits_starts_anew(monkeypatch):
    monkeypatch.setattr(last_token, "SEEN_PAIRS", 3)
    bpe = last_token.WordBpe(PATH)
    bpe.encode_sorted(["abcdefgh", "understandable", "unfathomably"])
    assert len(bpe.fit.seen) <= 3
    assert np.concatenate([[bpe.vocab[t] for t in w] for w in bpe.encode_sorted(["understandable"])]).tolist() == Tokenizer.from_file(PATH).encode("understandable", add_special_tokens=False).ids
