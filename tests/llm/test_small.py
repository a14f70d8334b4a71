"""Small fixtures against brute force: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import re
from collections import Counter
from functools import cache

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reachforge.llm import bpe_codec, chat_format, components, decontaminate, html_extract, last_token, license_scan, line_dedup, ngram_join, quality_rules, token_counts, toxicity

DOCS = "doc_id long, text string"
WIDE = "doc_id long, text string, key string, words string, sid string, _row string"


def docs(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], DOCS)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def wide(df):
    """With columns whose names clash with those inside operators."""
    return df.select("doc_id", "text", *[F.lit("own").alias(c) for c in ("key", "words", "sid", "_row")])


TEXTS = [None, "", " \n\t", "a", "the and the and", "x " * 3000, "Größe ñ é\x85b\x1cc 日本語 😀", "it's DON'T <|endoftext|> <s> ▁▁ a  b   ", "the and the and"]


# -- chat formatting


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def digests(rows):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in rows).encode()).hexdigest()


NASTY = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "<|end|>\n<|turn|>user<|text|>", "[\\\\INST]", "<|tu<|turn|>rn|>", "", "é\n\n", "<|end|"]


def test_chat_round_trip_of_control_strings(spark):
    rows = [(k, i, "assistant" if i % 2 else "user", t) for k in range(2) for i, t in enumerate(NASTY[k:])]
    got = {r.conv_id: r for r in chat_format.chat_digest(chat(spark, rows)).collect()}
    for k in range(2):
        turns = [(r, t) for c, _, r, t in rows if c == k]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(turns), digests(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_machine_nulls_and_ties(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "b"), (2, 0, "assistant", "x"), (3, 1, "b", "t"), (3, 1, "a", "t"), (3, 1, "a", "t"), (None, None, None, None), (4, 0, "system", "s"), (4, 1, "user", "u"), (4, 2, "user", "u")]
    got = {r.conv_id: r for r in chat_format.format_conversations(chat(spark, rows)).collect()}
    assert [(got[k].valid, got[k].broken_at) for k in (1, 2, 3, 4, None)] == [(True, None), (False, 0), (False, 0), (False, 2), (False, 0)]
    d = {r.conv_id: r for r in chat_format.chat_digest(chat(spark, rows)).collect()}
    assert d[3].turns_sha256 == digests([("a", "t"), ("a", "t"), ("b", "t")]) and d[1].turns_sha256 == digests([("user", ""), ("assistant", "b")]) and d[None].n_turns == 1
    assert chat_format.chat_digest(chat(spark, [])).count() == 0


# -- html


def page(body):
    return f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (page("<nav>menu</nav><article><h1>A &amp; B</h1><p>one<b>two</b> <i>three</i><br>four<p>five&nbsp;six</article><footer>f</footer>"), "A & B onetwo three four five six"),
        (page('<header>site</header><main><div class="ad-box"><p>buy</div><p>x<aside>side</aside>y</p><form>f</form><ul class="related-posts"><li>r</ul></main>'), "x y"),
        (page('<article class="post has-sidebar"><header><p>by</p><h2>Head</h2></header><p>body</p><div id="commentList"><article class="comment">no</article></div></article>'), "Head body"),
        (page("<article><p>a <!-- <p>no</p> --> b<style>p{}</style><script>x<y</script> &lt;tag&gt; &#233;&am</p></article>"), "a b <tag> é&am"),
        (page('<div class="cookie-notice">ok?</div><p>only text</p><div style="display: none">h</div>'), "only text"),
        ("plain < text", "plain < text"),
        ("", ""),
        (None, ""),
    ],
)
def test_html_main_text(source, want):
    assert html_extract.extract(source or "")[1] == want


PAGES = "page_id long, url string, html string"


def test_html_suffix_array_of_unmarked_pages(spark):
    legal = "all rights reserved by the owner of this site and its heirs"
    tale = "a tale that the host prints under two addresses, word by word the same, and longer than all else on its pages"
    rows = [(i, "http://h.example/1", page(f"<p>{legal}</p><p>tale{i} a{i} of b{i}, the only one of its kind, and longer by far than all that stands around it</p>")) for i in range(4)]
    rows += [(9, "http://other.example/", page(f"<p>{legal}</p>")), (10, None, None), (None, "x", page("<article>k</article>")), (10, None, None), (11, "http://h.example/z", page(f"<article><p>{legal}</p></article>"))]
    rows += [(20, "http://h.example/a", page(f"<p>{tale}</p>")), (21, "http://h.example/b", page(f"<p>{legal}</p><p>{tale}</p>"))]
    # the footer of a marked page tells what is boilerplate on another one
    rows += [(30, "http://two.example/a", page(f"<article>x y z</article><footer>{legal}</footer>")), (31, "http://two.example/b", page(f"<p>{tale}</p><p>{legal}</p>"))]
    df = spark.createDataFrame(rows, PAGES)
    got = html_extract.extract_pages(df.withColumn("tokens", F.lit(1)).withColumn("key", F.lit(1)))
    found = Counter((r.page_id, r.text, r.n_chars) for r in got.collect())
    want = [(i, t := f"tale{i} a{i} of b{i}, the only one of its kind, and longer by far than all that stands around it", len(t)) for i in range(4)] + [(9, legal, len(legal)), (10, "", 0), (10, "", 0), (None, "k", 1), (11, legal, len(legal))]
    # the ends of the tales are alike in nine words, so a run of them is a repeat
    repeat = " the only one of its kind, and longer by far than all that stands around it"
    want = [(i, t.removesuffix(repeat), len(t.removesuffix(repeat))) if n and t.startswith("tale") else (i, t, n) for i, t, n in want]
    want += [(20, tale, len(tale)), (21, tale, len(tale)), (30, "x y z", 5), (31, tale, len(tale))]
    assert found == Counter(want)
    assert html_extract.extract_pages(df.where("false")).count() == 0


def brute_repeats(streams, depth):
    """streams: (host, body, tokens). Of each the tokens in no run of `depth` that a page of the host with another body has."""
    out = []
    for host, body, tokens in streams:
        gone = set()
        for i in range(len(tokens) - depth + 1):
            run = tokens[i : i + depth]
            if any(h == host and b != body and any(ts[j : j + depth] == run for j in range(len(ts) - depth + 1)) for h, b, ts in streams):
                gone.update(range(i, i + depth))
        out.append(" ".join(t for i, t in enumerate(tokens) if i not in gone))
    return out


def test_html_repeats_against_brute_force(spark):
    import random

    r = random.Random(5)
    runs = [[f"r{k}w{i}" for i in range(12)] for k in range(5)]
    rows, streams = [], []
    for i in range(40):
        host = f"h{r.randrange(3)}.example"
        blocks = [" ".join(r.choice(runs)[r.randrange(4) :]) for _ in range(r.randrange(3))] + [" ".join(f"u{r.randrange(40)}" for _ in range(r.randrange(30)))]
        r.shuffle(blocks)
        rows.append((i, f"https://{host}/{i}", page("".join(f"<p>{b}</p>" for b in blocks))))
        streams.append((host, max(blocks, key=len), " ".join(blocks).split()))
    got = {x.page_id: x.text for x in html_extract.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i] for i in range(40)] == brute_repeats(streams, html_extract.DEPTH)


@pytest.mark.parametrize("source", ["<a '" * 250_000, "<a '" * 250_000 + ">", "<b>" * 150_000 + "<p>x" * 150_000, "<![CDATA[" * 110_000, "</i>" * 250_000, "<" * 1_000_000, "<div class='a'>" * 60_000 + "text", "<li>x" * 200_000, '<a "' + "<a '>" * 200_000])
def test_html_hostile_pages_take_linear_time(source):
    from time import perf_counter

    start = perf_counter()
    html_extract.extract(source)
    assert perf_counter() - start < 3


# -- tokens


def test_token_counts_and_every_prefix(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts.token_counts(wide(docs(spark, TEXTS)), limit=40).collect()}
    for i, t in enumerate(TEXTS):
        n = len(sp.encode(t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 40)
        assert len(sp.encode((t or "")[: got[i].fit_chars])) <= 40
        if got[i].fit_chars < len(t or ""):
            assert all(len(sp.encode(t[:k])) > 40 for k in range(got[i].fit_chars + 1, min(len(t), got[i].fit_chars + 30)))
    pc = token_counts.PrefixCounts(P.path("piece_bpe_32k.model"), kept=5)
    for t in ["", " ", "a", "  ", " ▁a  b▁ ", "x" * 300, "Hello there,  world\nnew 日本 😀", "ing thththe"]:
        assert pc.at(t) == [len(sp.encode(t[:i])) for i in range(len(t) + 1)]
    assert token_counts.token_counts(docs(spark, [])).count() == 0
    long = ["abcdefghij" * 5000, "日本" * 3000]
    got = token_counts.token_counts(docs(spark, long)).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(sp.encode(t)) for t in long]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeilnrst 'éß日😀\n1.,-A\x85́"), max_size=30))
def test_tokenizers_agree_with_their_libraries(t):
    codec, counts = library("word_bpe_49k.json"), library("piece_bpe_32k.model")
    ids = codec.bpe.lib.encode(t, add_special_tokens=False).ids
    assert coded(codec, [t]) == [(ids, " ".join(map(str, ids)), codec.bpe.lib.decode(ids, skip_special_tokens=False))]
    assert counts.at(t)[-1] == len(counts.bpe.lib.encode(t))


@cache
def library(name):
    return (bpe_codec.Codec if name.endswith("json") else token_counts.PrefixCounts)(P.path(name))


def coded(codec, texts):
    """Of each text: ids, their digits, and the text decoded from the ids."""
    offsets, ids = codec.encode(texts)
    lists = [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return list(zip(lists, [x.decode() for x in codec.digits(offsets, ids)], [x.decode() for x in codec.decode(offsets, ids)], strict=True))


def test_bpe_long_words_and_special_strings():
    from time import perf_counter

    codec = bpe_codec.Codec(P.path("word_bpe_49k.json"))
    texts = ["the" * 100_000, "é" * 30_000 + " x", "日本" * 500, "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|> é<|endoftext|>", "“a”<|endoftext|>日", "", "\ue000 \ue100x", "İ ı ŉ ǅ'Re"]
    start = perf_counter()
    got = coded(codec, texts)
    assert perf_counter() - start < 10
    assert [g[0] for g in got] == [codec.bpe.lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [g[2] for g in got] == [codec.bpe.lib.decode(g[0], skip_special_tokens=False) for g in got]


def test_bpe_documents(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in bpe_codec.encode_documents(wide(docs(spark, TEXTS)), keep_ids=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i].ids, got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (ids, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    small = bpe_codec.Codec(P.path("word_bpe_49k.json"), kept=3)
    assert [coded(small, [t or ""]) for t in TEXTS] == [coded(library("word_bpe_49k.json"), [t or ""]) for t in TEXTS]
    assert last_token.byte_alphabet()[32] == "Ġ" and bpe_codec.encode_documents(docs(spark, [])).count() == 0


# -- quality rules


def brute_base(t):
    w, ls = words(t), [x for x in (t or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(covered)


def test_quality_base_counts(spark):
    texts = [*TEXTS, "a b c d e f g h i " * 3, "one\ntwo\none\n\n\n \none", "w1 w2 w3 w4 w5 w6 w7 w8 x " + "w1 w2 w3 w4 w5 w6 w7 w8 y z " * 2, "### | a & <b>\x0bc\x0c"]
    got = {r.doc_id: r for r in quality_rules.quality(wide(docs(spark, texts))).collect()}
    for i, t in enumerate(texts):
        b = brute_base(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 20 or 100 * b[4] > 30 * b[0]) and (not r.base_failed or not r.kept)
    assert quality_rules.quality(docs(spark, [])).count() == 0


def test_quality_verdicts(spark):
    good = [" ".join(f"word{chr(97 + i % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(60)) for i in range(40)]
    junk = [" ".join(f"w{i}{j}###" for j in range(60)) for i in range(4)] + [" ".join(f"SHOUT{chr(65 + j % 26)}{chr(65 + j // 26)}!!" for j in range(60)) for _ in range(3)]
    df = docs(spark, [*good, *junk])
    kept = {r.doc_id for r in quality_rules.quality(df).where("kept").collect()}
    assert kept == set(range(40)) and {r.doc_id for r in quality_rules.filter_documents(wide(df)).collect()} == kept
    assert quality_rules.filter_documents(wide(df)).columns == wide(df).columns
    one = docs(spark, [good[0]] * 5)
    assert len({r.posterior for r in quality_rules.quality(one).collect()}) == 1 and quality_rules.quality(one).where("kept").count() == 5


def brute_em(votes, rounds=200):
    """Document by document, in plain loops."""
    import math

    rules = range(len(votes[0]))
    share, rates = quality_rules.GOOD, {c: [dict(zip("+-0", p, strict=True)) for _ in rules] for c, p in quality_rules.BEFORE.items()}
    for _ in range(rounds + 1):
        q = []
        for v in votes:
            g, b = (math.prod([x, *(rates[c][i][v[i]] for i in rules)]) for c, x in (("good", share), ("bad", 1 - share)))
            q.append(g / (g + b))
        weight = {"good": q, "bad": [1 - x for x in q]}
        share = (sum(q) + quality_rules.PRIOR * quality_rules.GOOD) / (len(votes) + quality_rules.PRIOR)
        for c, w in weight.items():
            for i in rules:
                n = {x: quality_rules.PRIOR * p + sum(wk for wk, v in zip(w, votes, strict=True) if v[i] == x) for x, p in zip("+-0", quality_rules.BEFORE[c], strict=True)}
                rates[c][i] = {x: k / sum(n.values()) for x, k in n.items()}
    return q


def test_quality_em_against_brute_force_and_single_rejections(spark):
    votes = ["+++++++++"] * 300 + ["--+++++++"] * 20 + ["---++-+++"] * 15 + ["+++++++-+"] * 9 + ["++-+++0++"] * 4 + ["-++++++++"]
    rows = spark.createDataFrame([(i, v, False) for i, v in enumerate(votes)], "doc_id long, votes string, base_failed boolean")
    got = [r.posterior for r in quality_rules.with_verdict(rows).orderBy("doc_id").collect()]
    assert got == pytest.approx(brute_em(votes), abs=1e-9)
    kept = {v: g >= 0.5 for v, g in zip(votes, got, strict=True)}
    assert kept["+++++++-+"] and not kept["--+++++++"] and not kept["---++-+++"]
    model = quality_rules.fit(Counter(votes))
    assert all(0.5 < a <= 1 for a in model["accuracy"]) and model["accuracy"][0] > 0.95


def test_quality_base_by_sql_and_long_texts(spark, tmp_path):
    import duckdb

    texts = [*TEXTS, "w1 w2 w3 w4 w5 w6 w7 w8 x " + "w1 w2 w3 w4 w5 w6 w7 w8 y z " * 3, " ".join(f"n{i}" for i in range(20_000)), "same words again \n" * 7000]
    df = docs(spark, texts)
    df.write.parquet(f"{tmp_path}/d")
    sql = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS w FROM '{tmp_path}/d/*.parquet'),
     p AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS x FROM d, unnest(range(1, len(w) - 6)) AS r(i)), q AS (SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
     n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM q, range(8) AS r(k) GROUP BY doc_id), l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d), m AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l WHERE regexp_matches(l, '[^ \t-\r]') GROUP BY doc_id)
     SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(m.n, 0) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words,
     len(w) < 20 OR 100 * coalesce(n.n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) ORDER BY doc_id"""
    want = duckdb.sql(sql).fetchall()
    got = quality_rules.quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


# -- line dedup


def brute_lines(rows, least):
    """By all runs of at least so many words, not the shortest ones only."""
    seen, runs, gone = {}, [], {}
    for key in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        ls = [x for x in (key[1] or "").split("\n") if words(x)]
        size = [len(words(x)) for x in ls]
        found = [(i, e) for i in range(len(ls)) for e in range(i + 1, len(ls) + 1) if sum(size[i:e]) >= least]
        for a, b in found:
            seen.setdefault(tuple(ls[a:b]), (key, a))
            runs.append((key, a, b, tuple(ls[a:b])))
    for key, a, b, k in runs:
        if seen[k] != (key, a):
            gone.setdefault(key, set()).update(range(a, b))
    out = []
    for key in rows:
        n, kept = -1, []
        for x in (key[1] or "").split("\n"):
            n += bool(words(x))
            if not words(x) or n not in gone.get(key, ()):
                kept.append(x)
        whole = key in gone and len(gone[key]) == len([x for x in key[1].split("\n") if words(x)])
        out.append((key[0], key[1] if key not in gone else "" if whole else "\n".join(kept), len(gone.get(key, ()))))
    return Counter(out)


LINES = ["a b c", "d e", "f", "", "g h i j", "k"]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.sampled_from(LINES), max_size=9).map("\n".join), min_size=1, max_size=12))
def test_lines_against_brute_force(spark, texts):
    rows = list(enumerate(texts))
    got = line_dedup.dedup_report(docs(spark, texts), min_words=6).collect()
    assert Counter((r.doc_id, r.text, r.n_deleted) for r in got) == brute_lines(rows, 6)


def test_lines_nulls_repeats_and_clashes(spark):
    long = "\n".join(f"line {i} of a long passage" for i in range(400))
    rows = [(1, long), (2, "own words\n" + long), (2, "own words\n" + long), (None, long), (None, long), (3, None), (4, ""), (5, "tail\n" * 300)]
    df = spark.createDataFrame(rows, DOCS)
    got = line_dedup.dedup_report(wide(df)).collect()
    assert Counter((r.doc_id, r.text, r.n_deleted) for r in got) == brute_lines(rows, 50)
    kept = line_dedup.dedup_documents(wide(df))
    assert kept.columns == wide(df).columns and sorted((r.doc_id or 0, r.text) for r in kept.where("text IS NOT NULL AND doc_id < 3").collect()) == [(1, long), (2, "own words"), (2, "own words")]
    assert line_dedup.dedup_report(docs(spark, [])).count() == 0


# -- n-gram join


def brute_join(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, base=60, copies=14):
    import random

    r = random.Random(seed)
    out = []
    for b in range(4):
        length = [6, 14, 20, base][b]
        w = [f"w{r.randrange(500)}" for _ in range(length)]
        for _ in range(copies):
            c = list(w)
            for _ in range(r.randrange(3)):
                c[r.randrange(length)] = f"x{r.randrange(9)}"
            out.append(" ".join(c))
    return [*out, None, "", "a b", "A B", "a b c d", " \n"]


@pytest.mark.parametrize(("n", "percent", "hot", "block"), [(4, 85, 48, 400), (5, 80, 1, 5), (1, 60, 2, 400)])
def test_join_against_brute_force(spark, monkeypatch, n, percent, hot, block):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
    texts = near_copies(n)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(wide(docs(spark, texts)), n, percent).collect()}
    assert got == brute_join(list(enumerate(texts)), n, percent)


def test_salted_lists_and_one_of_each(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SALTED", 5)
    texts = near_copies(3)
    want = brute_join(list(enumerate(texts)), 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs(spark, texts), 4, 80).collect()}
    assert got == want
    df = docs(spark, texts)
    kept = ngram_join.one_of_each(wide(df.union(df)), 4, 80)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()}) and kept.columns == wide(df).columns
    assert ngram_join.similar_components(docs(spark, [])).count() == 0
    null = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, "z z")], DOCS)
    assert sorted((r.doc_id or 0, r.component_id) for r in ngram_join.similar_components(null).collect() if r.component_id) == [(0, 7), (7, 7)]


def test_one_of_each_without_ids_and_with_repeated_ids(spark):
    """A row is chosen by its own component, whatever other rows of its id, or without one, are in."""
    near = [" ".join(f"{c}{i}" for i in range(60)) for c in "pqrs"]
    rows = [(None, near[0]), (None, near[0] + " tail"), (None, near[1]), (None, near[1]), (5, near[1] + " tail"), (7, near[2]), (7, near[3]), (6, near[3] + " tail"), (7, near[2] + " tail"), (None, ""), (None, ""), (None, None)]
    kept = Counter((r.doc_id, r.text) for r in ngram_join.one_of_each(wide(spark.createDataFrame(rows, DOCS))).collect())
    none = [x for x in kept if x[0] is None and x[1]]
    of_seven = [x for x in kept if x[0] == 7]
    assert len(none) == 1 and none[0] in rows[:2] and len(of_seven) == 1 and of_seven[0] in (rows[5], rows[8])
    assert kept == Counter([none[0], of_seven[0], rows[4], rows[7], (None, ""), (None, None)])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    parent = {v: v for e in edges for v in e if e[0] != e[1]}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.v: r.c for r in got} == {v: find(v) for v in parent}


def test_signatures_reach_every_similar_pair():
    import random

    import numpy as np

    r = random.Random(5)
    for percent in (60, 80, 85):
        sim = ngram_join.Similarity(percent)
        for _ in range(400):
            n, border = r.randrange(1, 24), r.choice([0, 6, 9])
            a = set(r.sample(range(40), n))
            b = set(r.sample(sorted(a), max(1, n - r.randrange(3)))) | set(r.sample(range(40), r.randrange(3)))
            k = len(a & b)
            if 100 * k < percent * len(a | b):
                continue
            order = {x: (x * 7) % 11 for x in range(40)}
            sig = [{(int(s), u < 0) for s, u in zip(*sim.signatures(np.array(sorted(x), np.uint64), np.array([order[v] for v in sorted(x)]), border), strict=True)} for x in (a, b)]
            assert sig[0] & sig[1], (a, b, border)


# -- decontamination


def brute_tiles(doc, item, seed):
    d, it, marks, total = [False] * len(doc), [False] * len(item), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not d[i + n] and not it[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < seed:
            return total
        for k in range(n):
            d[i + k] = it[j + k] = True
        total += n


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=3, max_size=25), st.lists(st.sampled_from("abc"), min_size=3, max_size=14))
def test_tiling_covers_what_brute_force_covers(doc, item):
    items = decontaminate.Items([(1, " ".join(item))], seed=3)
    got = items.leaks([" ".join(doc)], coverage=0.01)[0]
    want = brute_tiles(doc, item, 3)
    assert [round(c * len(item)) for _, c in got] == ([want] if want else [])


def test_tiling_of_long_repetitive_texts():
    from time import perf_counter

    item, start = "a " * 1000, perf_counter()
    assert decontaminate.Items([(1, item)]).leaks(["a " * 20_000]) == [[(1, 1.0)]]
    assert decontaminate.Items([(1, "a b " * 500)]).leaks(["b a " * 10_000, "b b a " * 9000]) == [[(1, 1.0)], []]
    assert perf_counter() - start < 2


def test_leaks_reordered_partial_and_clean(spark):
    item = [f"tok{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, " ".join(item))], "item_id long, text string")
    texts = ["x " + " ".join(item).upper() + "! y", " ".join(item[10:] + ["z"] + item[:10]), " ".join(item[:9]), " ".join(item[:10]), None, "", " ".join(item[::2]), ", ".join(item)]
    got = {r.doc_id: (r.contaminated, list(r.items)) for r in decontaminate.leak_report(wide(docs(spark, texts)), bench).collect()}
    assert {i for i, (c, _) in got.items() if c} == {0, 1, 3, 7} and got[0][1] == [1, 4]
    two = docs(spark, texts).union(docs(spark, texts))
    blocks = decontaminate.leak_report(two, bench, block_chars=150)
    assert blocks.count() == 16 and blocks.where("contaminated").count() == 8
    kept = decontaminate.drop_leaks(wide(two), bench, block_chars=150)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, 4, 4, 5, 5, 6, 6] and kept.columns == wide(two).columns
    assert decontaminate.drop_leaks(two, bench.where("false")).count() == 16
    assert decontaminate.leak_report(two.where("false"), bench).count() == 0
    long = docs(spark, ["own " + " word" * 50_000, " ".join(f"y{i}" for i in range(40_000)) + " " + " ".join(item)])
    assert [r.contaminated for r in decontaminate.leak_report(long, bench).orderBy("doc_id").collect()] == [False, True]


def test_decontamination_by_blocks_tells_rows_of_one_id_apart(spark):
    """Rows without an id, and texts under the same id, have their own verdicts at every size of the benchmark."""
    items = [" ".join(f"b{k}w{i}" for i in range(30)) for k in range(3)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(None, items[0]), (None, "clean"), (None, None), (None, items[1]), (7, items[2]), (7, "clean"), (7, "clean"), (8, items[0] + " " + items[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = lambda r: sorted((str(x.doc_id), x.contaminated, x.n_items, tuple(x.items), x.max_coverage) for x in r.collect())
    one, blocks = (decontaminate.leak_report(df, bench, block_chars=c) for c in (10**6, 100))
    assert one.columns == blocks.columns and plain(one) == plain(blocks)
    assert [x[:4] for x in plain(blocks) if x[1]] == [("7", True, 1, (2,)), ("8", True, 2, (0, 2)), ("None", True, 1, (0,)), ("None", True, 1, (1,))]


# -- licences


def brute_cosine(lines, templates):
    import math

    tok = lambda s: re.findall("[a-z0-9]+", s.lower())
    df = Counter(t for s in [*lines, *(t for _, t in templates)] for t in set(tok(s)))
    total = len(lines) + len(templates)
    vec = lambda s: {t: c * (math.log((1 + total) / (1 + df[t])) + 1) for t, c in Counter(tok(s)).items()}
    out = {}
    for s in set(lines):
        a, best = vec(s), []
        for name, t in templates:
            b = vec(t)
            dot = sum(x * b.get(k, 0) for k, x in a.items())
            best.append((-round(dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())), 9), name))
        if -min(best)[0] >= license_scan.THRESHOLD:
            out[s] = (min(best)[1], -min(best)[0])
    return out


def test_licences_and_inheritance(spark):
    mit, gpl, odd = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", "copyright of somebody else entirely here"
    rows = [(1, "a/LICENSE", mit), (2, "a/b/x.py", "code"), (3, "a/b/c/COPYING", f"text\n{gpl}"), (4, "a/b/c/d/y.py", None), (5, "a/z.py", gpl), (6, "q/n.py", odd), (7, None, "code"), (8, "a/b/c/LICENSE.txt", mit), (2, "a/b/x.py", "code"), (None, "a/n.py", ""), (9, "top.py", "x")]
    df = spark.createDataFrame(rows, "id long, path string, text string").withColumn("license", F.lit("clash"))
    got = license_scan.scan_licenses(df).collect()
    by = {(r.id, r.path): r for r in got}
    assert by[(2, "a/b/x.py")].license == "MIT" and by[(2, "a/b/x.py")].inherited and by[(5, "a/z.py")].license == "GPL-3.0" and by[(6, "q/n.py")].license is None and by[(None, "a/n.py")].from_path == "a/LICENSE" and by[(7, None)].license is None and len(got) == 11
    lines = [mit, gpl, odd, gpl, "Licensed under CC BY-NC 4.0.", "some licence of my own"]
    found = {r.line: (r.license, r.score) for r in license_scan.scored(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    want = brute_cosine(lines, license_scan.TEMPLATES)
    assert found.keys() == want.keys() and all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in want)
    assert license_scan.scan_licenses(df.where("false")).count() == 0


MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
int main(void) { return 0; }
"""
GPL = """#!/usr/bin/env python
#
# Copyright (C) 2019 Some Body
#
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
import os
value = os.environ["HOME"]
"""


def test_licence_headers_and_whole_texts(spark):
    """Wording of several lines, with names and years; reserved rights bar inheritance."""
    named = lambda n, who="Copyright (c) 2021 Jane Roe and contributors": license_scan.TEXTS[n].replace("Copyright (c)", who)
    in_lines = "".join(f"// {x}\n" for x in named("BSD-2-Clause").split("\n")) + "\nfn main() {}\n"
    essay = "A license to travel was asked of the people of the land, and the answer of the king to them was that it is not to be had by any of you. " * 9
    rows = [(k, f"d{k}/LICENSE", named(n)) for k, n in enumerate(sorted(license_scan.TEXTS))]
    rows += [(20, "a/x.c", MPL), (21, "a/x.py", GPL), (22, "a/x.rs", in_lines), (23, "e/LICENSE", essay), (24, "d9/mine.txt", "prose\nAll rights reserved."), (25, "d9/other.txt", "prose"), (26, "f/own.txt", "Copyright 2020 Some Firm, Ltd. All Rights Reserved.")]
    got = {r.id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "id long, path string, text string")).collect()}
    assert {k: got[k].license for k in range(len(license_scan.TEXTS))} == dict(enumerate(sorted(license_scan.TEXTS)))
    assert [got[k].license for k in range(20, 25)] == ["MPL-2.0", "GPL-3.0", "BSD-2-Clause", None, license_scan.RESERVED]
    assert not got[24].inherited and got[25].inherited and got[25].license == got[9].license and got[26].license == license_scan.RESERVED


# -- toxicity


def test_toxicity_held_out(spark):
    import random

    r = random.Random(1)
    bad, plain = ["idiot", "scum", "moron", "loser", "trash", "clown"], [f"w{i}" for i in range(300)]
    make = lambda k: " ".join(r.sample(plain, 40) + [f"{x}!" for x in r.sample(bad, k)])
    hits = [0] * 160 + [1, 2, 3, 5] * 15
    texts = [make(k) for k in hits]
    df, labels = docs(spark, [*texts, None, ""]), spark.createDataFrame([(i, 1, int(k > 0)) for i, k in enumerate(hits) if i % 3], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.severity(wide(df), labels).collect()}
    held = [i for i in range(len(hits)) if not i % 3]
    assert sum(got[i].toxic == (hits[i] > 0) for i in held) / len(held) > 0.95
    mean = lambda k: sum(got[i].severity for i in held if hits[i] == k) / sum(hits[i] == k for i in held)
    assert mean(0) < mean(1) < mean(5) and not got[len(texts)].toxic and not got[len(texts) + 1].toxic
    none = toxicity.severity(df, labels.where("false")).collect()
    assert len(none) == len(texts) + 2 and not any(x.toxic for x in none)


def test_toxicity_of_stems_with_many_endings_in_a_small_language(spark):
    """Toxic words of the second language are all different; they share a stem, of which clean texts hold one word at most."""
    import random

    r = random.Random(2)
    bad, plain, toxic = ["idiot", "scum", "moron", "loser", "trash", "clown"], [f"w{i}" for i in range(300)], [i % 4 == 0 for i in range(900)]
    ending = lambda: "".join(r.choices("abcdefghijklmnop", k=6))
    lang = ["en" if i % 5 else "de" for i in range(900)]
    some = lambda i: [f"achlich{ending()}" for _ in range(r.choice([2, 3, 4]) if toxic[i] else r.choice([0, 0, 1]))] if lang[i] == "de" else r.sample(bad, 3 * toxic[i])
    rows = [(i, " ".join(r.sample(plain, 40) + some(i)), lang[i]) for i in range(900)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = [i for i in range(900) if i // 20 % 3 == 0]
    labels = spark.createDataFrame([(i, 1, int(toxic[i])) for i in range(900) if i not in held], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.toxic for x in toxicity.severity(df, labels).collect()}
    for k in ("en", "de"):
        mine = [i for i in held if lang[i] == k]
        assert sum(got[i] for i in mine if toxic[i]) >= 0.8 * sum(toxic[i] for i in mine) > 0, k
        assert sum(got[i] for i in mine if not toxic[i]) <= 0.02 * len(mine), k
    assert toxicity.severity(df.drop("lang"), labels).where("toxic").count() > 0.8 * sum(toxic)


def test_stems_count_distinct_words():
    words = toxicity.Words()
    found = lambda t: {int(h) & toxicity.CODE for h in words.found([t])[0]}
    assert found("abc abc") == {0} and found("abcdx abcdx") == {0, 1} and found("ABCDX, abcdy abcdz") == {0, 1, 2, 3} and found("abcdefx abcdefy") == {0, 1, 2, 5, 6}
    assert len(words.found(["", "abcd abcd", "abcd"])[0]) == 4 and not len(words.found([""])[0])


def test_ordinal_gradient_and_order():
    import numpy as np

    rng = np.random.default_rng(0)
    x = (rng.random((400, 3)) < 0.3).astype(np.float32)
    grade = np.clip((x @ [2, 1, 0] + rng.random(400)).astype(int), 0, 3)
    m = toxicity.ordinal(x, grade, 3, 500)
    assert m["weights"][0] > m["weights"][1] > abs(m["weights"][2]) and (np.diff(m["thresholds"]) > 0).all()


# -- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    base = [" ".join(f"{chr(97 + (i * 7 + j * j) % 26)}{chr(97 + (j * 5 + i) % 26)}{chr(97 + (i * j) % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}{chr(97 + i)}" for j in range(80)) for i in range(12)]
    item = " ".join(f"bench{i}" for i in range(30))
    texts = [*base, "short", base[0], base[1] + " tail", base[2] + "\n" + item, None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "n-gram jaccard join", "benchmark decontamination", "bpe encoding"]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # short and null texts fail the base; 13 repeats 0, 14 is near 1, and 15 holds the benchmark item and line 2
    assert sorted(r.doc_id for r in out) == list(range(12)) and all(r.n_tokens == len(r.ids) for r in out)



def test_pipeline_of_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls in any column, repeated rows, rows without id, clashing columns, and tables without rows."""
    import corpus_pipeline

    text = [" ".join(f"{chr(97 + (i * 7 + j * j) % 26)}{chr(97 + (j * 5 + i) % 26)}{chr(97 + (i * j) % 26)}{chr(97 + j % 26)}{chr(97 + j // 26)}{chr(97 + i)}" for j in range(80)) for i in range(5)]
    rows = [(0, text[0], None, None, None), (0, text[0], None, None, None), (None, text[1], "en", "s", 1), (None, text[1], "en", "s", 1), (2, None, "en", "s", 0), (None, None, None, None, None), (3, text[3], "en", "s", 1), (3, text[4], "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, docs_, bench in (("odd", df, 0), ("none", df.where("false"), 0)):
        folder = f"{tmp_path}/{name}"
        docs_.withColumn("key", F.lit("own")).withColumn("sid", F.lit("own")).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(None, None)] * bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == ([(False, 0), (False, 3), (False, 3), (True, 0)] if name == "odd" else [])
