"""Lists that are kept as JSON text in a cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "CAST(array() AS array<string>)"
#: Words of literal lists, in JSON.
LITERALS = {"None": "null", "True": '"True"', "False": '"False"'}


def compact(c: Column) -> Column:
    """JSON without spaces; blank where null."""
    return F.coalesce(F.to_json(c), F.lit(""))


def _list(c: Column, folded: bool = False) -> Column:
    """The array that the text holds, as JSON or as a literal list with single quotes, None, True and False (in small letters if folded); null if it holds none."""
    s = F.trim(c)
    literal = s
    for word, json in LITERALS.items():
        word, json = (word.lower(), json.lower()) if folded else (word, json)
        literal = F.regexp_replace(literal, rf"(?<=[\[,]\s{{0,9}}){word}(?=\s*[,\]])", json)
    return F.when(s.startswith("["), F.coalesce(F.from_json(s, "array<string>"), F.from_json(F.regexp_replace(literal, r",\s*\]$", "]"), "array<string>", {"allowBackslashEscapingAnyCharacter": "true"})))


def _scalar(c: Column) -> Column:
    s = F.trim(c)
    quoted = s.rlike(r'^"(?:[^"\\]|\\.)*"$')
    return F.when(quoted, F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), F.lit(0))).otherwise(c)


def parse(c: Column, nulls: str = "keep") -> Column:
    """Text to array<string>: blank and null give [], a JSON scalar [scalar], other text [text]. nulls: 'keep', 'drop', or 'blank' (null items become '')."""
    empty = F.expr(EMPTY)
    items = F.when(c.isNull() | (F.trim(c) == "") | (F.trim(c) == "null"), empty).otherwise(F.coalesce(_list(c), F.array(_scalar(c))))
    if nulls == "drop":
        return F.filter(items, lambda x: x.isNotNull())
    return F.transform(items, lambda x: F.coalesce(x, F.lit(""))) if nulls == "blank" else items


def parse_strict(c: Column) -> Column:
    """Null unless the text is a JSON list; items trimmed, nulls dropped."""
    return F.transform(F.filter(_list(c), lambda x: x.isNotNull()), lambda x: F.trim(x))


def multiset(c: Column) -> Column:
    """Items trimmed and sorted, repeats kept."""
    return F.array_sort(F.transform(parse(c, "drop"), lambda x: F.trim(x)))


def same_list(a: Column, b: Column) -> Column:
    return multiset(a).eqNullSafe(multiset(b))


def same_text(a: Column, b: Column) -> Column:
    return F.trim(F.coalesce(a, F.lit(""))) == F.trim(F.coalesce(b, F.lit("")))


def structural(c: Column, fold) -> Column:
    """A canonical value: lists trimmed, folded, sorted and joined by bars; other text folded."""
    folded = fold(F.trim(F.coalesce(c, F.lit(""))))
    listed = F.array_join(F.array_sort(F.transform(_list(folded, True), lambda x: F.trim(F.coalesce(x, F.lit(""))))), "|")
    return F.coalesce(listed, folded)
