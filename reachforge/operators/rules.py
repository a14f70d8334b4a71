"""First-match text rules: an ordered rule table, compiled into one conditional expression over text that is normalised once. The phrases of all signals are found by one automaton in one pass over the text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.automaton import first_of
from ..functions.text import normalise_a, python_normalise_a


@dataclass(frozen=True)
class Signal:
    """Phrases, matched as substrings of normalised text, or regular expressions. The first in the list that matches counts."""

    terms: tuple[str, ...]
    regex: bool = False

    def match(self, text: Column, place: Column) -> Column:
        """(term as written, what to look for in normalised text) of the first match, or null. place: of the first phrase in the text, or -1."""
        if self.regex:
            return F.coalesce(*[F.when(text.rlike(t), F.struct(F.lit(t).alias("term"), F.lit(n).alias("n"))) for t, n in self.pairs()], F.lit(None))
        return F.get(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(n).alias("n")) for t, n in self.pairs()]), place)

    def field(self, found: Column, texts: dict[str, Column]) -> Column:
        """The first field that holds the matched term, else combined_text."""
        if not self.regex:
            return F.coalesce(*[F.when(x.contains(found["n"]), F.lit(name)) for name, x in texts.items()], F.lit("combined_text"))
        return F.coalesce(*[F.when((found["term"] == t) & x.rlike(t), F.lit(name)) for name, x in texts.items() for t in self.terms], F.lit("combined_text"))

    def pairs(self) -> list[tuple[str, str]]:
        return [(t, t if self.regex else python_normalise_a(t)) for t in self.terms]


@dataclass(frozen=True)
class Rule:
    """Fires when all its signals match. Two signals report 'a + b' in combined_text."""

    name: str
    verdict: str
    reason: str
    signals: tuple[str, ...]


def classify(df: DataFrame, fields: list[str], signals: dict[str, Signal], rules: list[Rule], default: Rule, empty: Rule, fold=None) -> DataFrame:
    """Adds commercial_eligibility, eligibility_reason, matched_rule, matched_field and matched_text. fields: array<string> or text columns; items are normalised one by one and fields joined by spaces, so a phrase may straddle them. empty applies to rows without text."""
    norm = (lambda c: normalise_a(c, fold)) if fold else normalise_a
    kinds = dict(df.dtypes)
    text_of = lambda f: norm(F.array_join(F.col(f), " ") if kinds[f].startswith("array") else F.col(f))
    t = df.withColumns({f"_t_{f}": text_of(f) for f in fields}).withColumn("_text", F.trim(F.regexp_replace(F.concat_ws(" ", *[F.col(f"_t_{f}") for f in fields]), " +", " ")))
    used = list(dict.fromkeys(s for r in rules for s in r.signals))
    phrases = [s for s in used if not signals[s].regex]
    t = t.withColumn("_at", first_of([[n for _, n in signals[s].pairs()] for s in phrases])(F.col("_text")) if phrases else F.array())
    t = t.withColumns({f"_m_{s}": signals[s].match(F.col("_text"), F.get("_at", F.lit(phrases.index(s) if s in phrases else -1))) for s in used})
    texts = {f: F.col(f"_t_{f}") for f in fields}

    def outcome(r: Rule) -> Column:
        matched = [F.col(f"_m_{s}") for s in r.signals]
        where = signals[r.signals[0]].field(matched[0], texts) if len(matched) == 1 else F.lit("combined_text" if matched else "")
        what = F.concat_ws(" + ", *[m["term"] for m in matched]) if matched else F.lit("")
        return F.struct(F.lit(r.verdict).alias("commercial_eligibility"), F.lit(r.reason).alias("eligibility_reason"), F.lit(r.name).alias("matched_rule"), where.alias("matched_field"), what.alias("matched_text"))

    out = F.when(F.col("_text") == "", outcome(empty))
    for r in rules:
        test = F.col(f"_m_{r.signals[0]}").isNotNull()
        for s in r.signals[1:]:
            test = test & F.col(f"_m_{s}").isNotNull()
        out = out.when(test, outcome(r))
    return t.withColumn("_r", out.otherwise(outcome(default))).select(*df.columns, "_r.*")


def route(classified: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, for review, excluded); rows for review are kept too."""
    v = F.col("commercial_eligibility")
    gone = v.startswith("exclude")
    return classified.where(~gone), classified.where(v == "manual_review"), classified.where(gone)
