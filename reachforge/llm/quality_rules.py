"""Quality rules by weak supervision. DataFrame functions only.

Rules vote keep, reject or abstain on each document. Expectation maximisation over the counts of vote patterns estimates the share of
good documents and, for good and for bad ones, how often each rule votes which way; from these follow each rule's accuracy and the
posterior probability of a document being good, and it is kept when that reaches a half. So a rejection weighs as much as it is found
together with others, and documents with one rejection may stay. There are at most 3^rules patterns whatever the input, so only that
bounded table reaches the driver.

Hard floor (base): fewer than 20 words, or more than 30 % of words in 8-word windows that the text holds twice or more.

Defined results: a null or empty text has no words and fails the base; repeated rows get the same verdict; a table without rows
gives none; documents that all have the same votes have the same posterior; very long texts are counted whole, one at a time; columns
other than doc_id and text are ignored (`filter_documents` hands them on unchanged).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, let, whole

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: By rule: a percentage or mean, the range in which the rule votes keep, and the range in which it rejects; outside both it abstains. Each kind of junk is seen by several rules, as estimating accuracies takes rules that overlap.
RULES = {
    "symbols": ("100.0 * n_symbols / greatest(word_chars, 1)", (None, 3.0), (8.0, None)),
    "symbol_runs": ("100.0 * n_symbol_runs / greatest(n_words, 1)", (None, 10.0), (25.0, None)),
    "letters": ("100.0 * n_letters / greatest(word_chars, 1)", (85.0, None), (None, 75.0)),
    "capitals": ("100.0 * n_capitals / greatest(n_letters, 1)", (None, 20.0), (50.0, None)),
    "marks": ("100.0 * n_marks / greatest(n_words, 1)", (None, 10.0), (25.0, None)),
    "small_letters": ("100.0 * (n_letters - n_capitals) / greatest(word_chars, 1)", (70.0, None), (None, 50.0)),
    "dup_lines": ("100.0 * n_dup_lines / greatest(n_lines, 1)", (None, 10.0), (30.0, None)),
    "repeats": ("100.0 * n_repeat_words / greatest(n_words, 1)", (None, 10.0), (20.0, None)),
    "long_words": ("1.0 * word_chars / greatest(n_words, 1)", (2.0, 12.0), (16.0, None)),
}


def names(words: Column, n: int) -> Column:
    """64-bit names of all n-word windows, n a power of two, by doubling: a window's name is made of those of its two halves."""
    x = F.transform(words, lambda w: F.xxhash64(w))
    step = 1
    while step < n:
        x = _double(x, step)
        step *= 2
    return x


def _double(x: Column, step: int) -> Column:
    return let(x, lambda y: F.zip_with(_from(y, 1, step), _from(y, step + 1, step), lambda a, b: F.xxhash64(a, b)))


def _from(x: Column, start: int, less: int) -> Column:
    """So many items fewer than x has, from the one numbered start."""
    return F.slice(x, F.lit(start), F.greatest(F.size(x) - less, F.lit(0)))


def repeat_words(windows: Column, n: int = WINDOW) -> Column:
    """Words inside windows whose name occurs twice or more. Only texts with an equal pair are sorted."""

    def starts(pairs: Column) -> Column:
        """Of sorted (name, place) pairs: the places of those with an equal neighbour, in order."""
        equal = F.zip_with(_from(pairs, 1, 1), _from(pairs, 2, 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.array_sort(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull()))))

    def covered(at: Column) -> Column:
        return F.aggregate(F.zip_with(_from(at, 1, 1), _from(at, 2, 1), lambda a, b: F.least(b - a, F.lit(n))), F.lit(n), lambda s, g: s + g)

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(let(pairs, starts), covered)).cast("long")


def metrics(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the counts of the base and those of the rules."""
    text = whole("text")
    d = docs.select("doc_id", text.alias("text"))
    d = d.withColumn("words", F.filter(F.split(F.regexp_replace("text", SPACE, " "), " "), lambda w: w != ""))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda s: s.rlike("[^ \t-\r]")))
    size = lambda c: F.size(c).cast("long")
    kept_chars = lambda drop: F.length(F.regexp_replace("text", drop, "")).cast("long")
    return d.select(
        "doc_id", size("words").alias("n_words"), kept_chars(r"[ \t-\r]+").alias("word_chars"), kept_chars(r"[^#*$%&|<>]+").alias("n_symbols"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"), let(names(F.col("words"), WINDOW), repeat_words).alias("n_repeat_words"),
        size("lines").alias("n_lines"), kept_chars(r"[^\p{L}]+").alias("n_letters"), kept_chars(r"[^\p{Lu}]+").alias("n_capitals"), F.regexp_count("text", F.lit("[#*$%&|<>]+")).cast("long").alias("n_symbol_runs"), kept_chars(r"[^!?]+").alias("n_marks"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def votes(m: DataFrame) -> DataFrame:
    """Adds a column of votes, one character a rule: + keep, - reject, 0 abstain."""
    def within(x: str, bounds: tuple | None) -> Column:
        low, high = bounds or (1, 0)
        return (F.expr(x) >= low if low is not None else F.lit(True)) & (F.expr(x) <= high if high is not None else F.lit(True))

    one = lambda x, keep, reject: F.when(within(x, reject), "-").when(within(x, keep), "+").otherwise("0")
    return m.withColumn("votes", F.concat(*[one(*r) for r in RULES.values()]))


VOTES = "+-0"
#: How often a rule is thought to vote keep, reject or abstain, on good and on bad documents, and the share of good ones, before any vote is seen. It counts as PRIOR documents.
BEFORE = {"good": (0.80, 0.05, 0.15), "bad": (0.45, 0.35, 0.20)}
GOOD, PRIOR = 0.8, 20.0


def fit(patterns: dict[str, int], rounds: int = 200) -> dict:
    """Expectation maximisation: the share of good documents, each rule's vote rates for good and bad ones, and its accuracy: how often it is right when it votes."""
    import numpy as np

    rules, keys = len(RULES), sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    cast = np.array([[[v == w for w in VOTES] for v in k] for k in keys], float).reshape(len(keys), rules, 3)
    before = np.array([[BEFORE[c]] * rules for c in ("good", "bad")])
    share, rates = GOOD, before
    for _ in range(rounds):
        log = np.log([share, 1 - share])[:, None] + np.einsum("prv,crv->cp", cast, np.log(rates))
        q = 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))
        weight = np.stack([n * q, n * (1 - q)])
        counts = np.einsum("cp,prv->crv", weight, cast) + PRIOR * before
        share, rates = (weight[0].sum() + PRIOR * GOOD) / (n.sum() + PRIOR), counts / counts.sum(2, keepdims=True)
    right, voted = share * rates[0, :, 0] + (1 - share) * rates[1, :, 1], share * rates[0, :, :2].sum(1) + (1 - share) * rates[1, :, :2].sum(1)
    return {"good": float(share), "rates": rates, "accuracy": (right / voted).tolist()}


def log_odds(model: dict) -> Column:
    """The log odds of being good, of the votes."""
    x = F.lit(math.log(model["good"] / (1 - model["good"])))
    for i in range(len(RULES)):
        v, (good, bad) = F.substring("votes", i + 1, 1), model["rates"][:, i]
        says = [float(math.log(g / b)) for g, b in zip(good, bad, strict=True)]
        x = x + F.when(v == "+", says[0]).when(v == "-", says[1]).otherwise(says[2])
    return x


def with_verdict(m: DataFrame) -> DataFrame:
    """Adds posterior and kept to written rows with votes."""
    patterns = {r["votes"]: r["count"] for r in m.where(~F.col("base_failed")).groupBy("votes").count().collect()}  # 3^rules rows at most
    return m.withColumn("posterior", 1 / (1 + F.exp(-log_odds(fit(patterns))))).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def score(docs: DataFrame) -> DataFrame:
    """Metrics with posterior and kept. The metrics are written once; both the fit and the verdicts read them."""
    return with_verdict(cut(votes(metrics(docs))))


def quality(docs: DataFrame) -> DataFrame:
    return score(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior", "votes")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The kept rows with all their columns. The rows are written once with their votes, so no text is counted twice or shuffled."""
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("doc_id")
    rows = cut(votes(metrics(docs.select(own, "text"))).select("doc_id", "base_failed", "votes"))
    return with_verdict(rows).where("kept").select("doc_id.*")
