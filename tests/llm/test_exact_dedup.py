"""Exact dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reachforge.llm import exact_dedup

DOCS = "doc_id long, text string"


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    out = []
    for plain, members in groups.items():
        members.sort()
        for k, (_, none, i) in enumerate(members):
            out.append((None if none else i, None if members[0][1] else members[0][2], len(members), k == 0, hashlib.sha256(plain.encode()).hexdigest()))
    return Counter(out)


def rows_of_all_kinds():
    r = random.Random(3)
    make = lambda n: "".join(r.choice("abcde .\n\té日😀") for _ in range(n))
    long = make(60_000)
    texts = [None, "", " \t\n\x0b\x0c\r", "a b", "ab", " a  b ", "ab", "a\x1cb", "a b", "a\x85b", long, long.replace(" ", "  "), long[:-1] + "x", "x" * 20_000, "x" * 20_001, "." * 9000]
    texts += [make(n) for n in (511, 512, 513, 514, 8192, 8193, 8194)]
    near = [make(3000) for _ in range(4)]
    texts += near + [t[:1500] + "Q" + t[1500:] for t in near] + [t.replace("\n", " ") for t in near]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "ab"), (None, "ab"), (None, "only"), (3, "a b"), (3, "a b"), (3, "b a"), (77, "tie 1"), (76, "tie1 "), (75, "tie1 ")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [64, 4, 1])
def test_report_equals_brute_force_also_where_hashes_of_chunks_clash(spark, bits):
    rows = rows_of_all_kinds()
    df = spark.createDataFrame(rows, DOCS).select("doc_id", "text", *[F.lit("own").alias(c) for c in ("recipe", "id", "_row", "sha", "less", "best")])
    got = exact_dedup.dedup_report(df, bits)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(tuple(x) for x in got.collect()) == brute(rows)
    kept = exact_dedup.dedup_documents(df, bits)
    assert kept.columns == df.columns and Counter(x.doc_id for x in kept.collect()) == Counter(i for (i, _, _, k, _), n in brute(rows).items() for _ in range(n) if k)


def test_chunks_make_up_the_text_and_follow_its_content(spark):
    r = random.Random(4)
    text = "".join(r.choice("abcdefgh.") for _ in range(30_000))
    moved = text[:1000] + "inserted" + text[1000:]
    df = spark.createDataFrame([(0, text), (1, moved)], DOCS)
    a, b = (x[0] for x in df.orderBy("doc_id").select(exact_dedup.chunks(exact_dedup.normal())).collect())
    assert "".join(a) == text and "".join(b) == moved and len(set(a) & set(b)) > 0.9 * len(a)
    assert all(exact_dedup.LEAST < len(c) <= exact_dedup.LEAST + exact_dedup.MORE + 1 and c[-1] == "." for c in a[:-1])
    store = {x.chunk for x in exact_dedup.chunk_store(df).collect()}
    assert store == set(a) | set(b)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert exact_dedup.dedup_report(df).count() == exact_dedup.dedup_documents(df).count() == 0


def test_one_group_of_a_third_of_all_rows(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    assert Counter(tuple(x) for x in exact_dedup.dedup_report(spark.createDataFrame(rows, DOCS)).collect()) == brute(rows)
