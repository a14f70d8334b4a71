"""Long, tied, clashing and empty inputs that other tests leave out."""

import hashlib

import public_tokenizers as P
from pyspark.sql import functions as F

from reachforge.llm import chat_format, html_extract, ngram_join, token_counts, toxicity

DOCS = "doc_id long, text string"


def test_long_conversations_and_clashing_columns(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"turn {k} <|end|> " + "x" * (k % 50)) for k in range(3000)]
    turns += [(2, 0, "user", "u" * 300_000), (2, 1, "assistant", "a\n" * 200_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").select("*", *[F.lit("own").alias(c) for c in ("valid", "segments", "turns", "n_turns", "key")])
    got = {r.conv_id: r for r in chat_format.chat_digest(df).collect()}
    for c in (1, 2):
        mine = [t for t in turns if t[0] == c]
        loss = "".join(t[3] for t in mine if t[2] == "assistant")
        assert got[c].n_turns == len(mine) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in mine).encode()).hexdigest()


def test_very_long_texts_in_the_join(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(60_000)]
    long = " ".join(words)
    rows = [(5, long), (3, " ".join(words[:58_000])), (7, " ".join(words[:40_000])), (9, "a b c d e"), (None, long), (1, None)]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.similar_components(spark.createDataFrame(rows, DOCS), 4, 85).collect()}
    assert got[5, 59_997] == got[3, 57_997] == got[None, 59_997] == 3 and got[7, 39_997] == 7 and got[9, 2] == 9 and got[1, 0] == 1


def test_private_characters_in_token_counts(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    texts = ["a\ue000\ue001 b\uefff", "\ue000", "ab\ue123" * 50, "\u2581\u2581 \u2581\uf8ff"]
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert got == {k: len(lib.encode(t)) for k, t in enumerate(texts)}


def test_pages_without_main_text_and_blocks_of_equal_length(spark):
    page = "<html><body><div>{0}</div><div>{1}</div></body></html>"
    rows = [(k, "http://h.org/x", page.format(a, b)) for k, (a, b) in enumerate([("same length a", "same length b"), ("same length b", "same length a"), ("x", "x")])]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "same length a same length b", 1: "same length b same length a", 2: "x x"}


def test_toxicity_of_no_documents_ties_and_long_texts(spark):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(40)], "doc_id long, quality int, toxic int")
    tied = [(k, "idiot scum moron" if k % 2 else "kind calm words") for k in range(40)] + [(99, "calm " * 100_000 + "idiot scum moron"), (98, "kind " * 100_000)]
    df = spark.createDataFrame(tied, DOCS)
    got = {r.doc_id: r for r in toxicity.severity(df, labels).collect()}
    assert all(got[k].toxic == bool(k % 2) for k in range(40)) and not got[98].toxic
    assert got[1].severity == got[3].severity and toxicity.severity(df.where("false"), labels).count() == 0
