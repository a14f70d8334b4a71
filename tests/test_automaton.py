import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reachforge.functions import automaton
from reachforge.functions.automaton import Automaton
from reachforge.functions.text import python_normalise_a
from reachforge.operators import eligibility_rules, rules


def pairs(machine, texts):
    return {(int(t), machine.phrases[p]) for t, p in zip(*machine.found(texts), strict=True)}


def brute(phrases, texts):
    return {(k, p) for k, t in enumerate(texts) for p in phrases if p and p in t}


@given(st.lists(st.text("abß", max_size=4), max_size=12), st.lists(st.text("abßx", max_size=30), max_size=8))
@settings(max_examples=300, deadline=None)
def test_overlapping_phrases_equal_substring_search(phrases, texts):
    assert pairs(Automaton(phrases), texts) == brute(phrases, texts)


@pytest.mark.parametrize("segment", [1, 3, 7, 512])
def test_phrases_across_the_bounds_of_segments_and_groups(monkeypatch, segment):
    monkeypatch.setattr(automaton, "SEGMENT", segment)
    monkeypatch.setattr(automaton, "GROUP", 50)
    r = random.Random(segment)
    phrases = ["a", "ab", "abab", "bab", "babba", "abbabababab", "日b", "😀", "aa"]
    texts = ["".join(r.choice("ab日😀") for _ in range(r.choice([0, 1, 5, 40, 300]))) for _ in range(60)] + ["", "ab" * 700]
    assert pairs(Automaton(phrases), texts) == brute(phrases, texts)


def test_first_phrase_of_each_list(spark):
    r = random.Random(1)
    lists = [["bab", "ab", "a"], ["b"], ["zz", "abb", "b"], [], ["q", ""], ["bab"]]
    texts = [None, "", *["".join(r.choice("abz") for _ in range(r.randrange(9))) for _ in range(200)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("at", automaton.first_of(lists)(F.col("t")))
    for x in df.collect():
        assert x["at"] == [next((k for k, p in enumerate(ps) if p in (x.t or "")), -1) for ps in lists]


def test_all_term_lists_equal_one_search_a_term(spark):
    """Texts made of pieces of the terms, so that terms overlap, stand inside others and break off."""
    r = random.Random(5)
    signals = {k: [python_normalise_a(t) for t in s.terms] for k, s in eligibility_rules.SIGNALS.items() if not s.regex}
    every = [t for ts in signals.values() for t in ts]
    pieces = [t[: r.randrange(1, len(t) + 1)] for t in every] + every
    texts = ["".join(r.choice(pieces) + r.choice(["", " ", "e", "n"]) for _ in range(r.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("at", automaton.first_of(list(signals.values()))(F.col("t")))
    for x in df.collect():
        assert x["at"] == [next((k for k, p in enumerate(ps) if p in x.t), -1) for ps in signals.values()]


def test_rules_without_phrases(spark):
    only = {"m": rules.Signal((r"a+b",), regex=True)}
    got = rules.classify(spark.createDataFrame([("xaab",), ("x",), (None,)], "t string"), ["t"], only, [rules.Rule("r", "out", "why", ("m",))], rules.Rule("d", "in", "", ()), rules.Rule("e", "in", "", ()))
    assert [(x.matched_rule, x.matched_text) for x in got.collect()] == [("r", "a+b"), ("d", ""), ("e", "")]
