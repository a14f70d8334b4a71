"""Numbers, shares, flags and categories."""

from __future__ import annotations

from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .jsonlist import parse_strict

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit(""))) == ""


def number(c: Column) -> Column:
    """A finite number, else null; Spark alone would take NaN and 1d."""
    return F.when(c.rlike(NUMBER), F.nullif(F.nullif(c.try_cast("double"), F.lit(float("inf"))), F.lit(float("-inf"))))


def all_sum(cols: list[Column]) -> Column:
    """Null if any part is null."""
    return reduce(add, cols)


def ratio(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d)


def percent(n: Column, d: Column, blank_zero: bool = False) -> Column:
    return F.when(d != 0, F.round(100.0 * n / d, 4)).otherwise(F.lit(None).cast("double") if blank_zero else F.lit(0.0))


def midpoint(low: Column, high: Column) -> Column:
    """Half to even."""
    return F.bround((low + high) / 2).cast("long")


def usable(d: Column) -> Column:
    return F.coalesce(d > 0, F.lit(False)).cast("int")


def unknown_flag(c: Column) -> Column:
    return F.when(c.isNotNull(), (c > 0).cast("int"))


def boundary(share: Column) -> Column:
    return F.when(share == 0, "Zero").when(share == 1, "One").when(share.isNotNull(), "Interior")


def factor(c: Column, levels: list[str]) -> Column:
    """Values outside the levels become null."""
    return F.when(c.isin(*levels), c)


def age_scope(c: Column) -> Column:
    """Broad for exactly 18 to 65, Narrow for other ordered ranges."""
    items = parse_strict(c)
    low, high = F.get(items, F.lit(0)).try_cast("int"), F.get(items, F.lit(1)).try_cast("int")
    return F.when((F.size(items) == 2) & (low == 18) & (high == 65), "Broad").when((F.size(items) == 2) & (low >= 0) & (low <= high), "Narrow")


def platform_category(c: Column, first: str = "facebook", second: str = "instagram") -> Column:
    """Null where the text is no list; an empty list, or one with a repeat, falls to Other."""
    items = F.transform(parse_strict(c), lambda x: F.lower(x))
    has = lambda p: F.array_contains(items, p)
    n = F.size(items)
    return F.when(items.isNull(), F.lit(None)).when((n == 2) & has(first) & has(second), "Both").when((n == 1) & has(first), f"{first.capitalize()}-only").when((n == 1) & has(second), f"{second.capitalize()}-only").otherwise("Other")


@F.pandas_udf(StringType())
def number_text(c: pd.Series) -> pd.Series:
    """Integers without a point, else 15 significant digits; only at a text edge. Built-in formats round the shortest decimal text of a number, not the number."""
    return c.map(lambda v: "" if v is None or v != v else str(int(v)) if float(v).is_integer() else format(v, ".15g"))


def share_with_unknown(n: Column, known: Column, unknown: Column) -> Column:
    """A share whose denominator counts the unknown too; a missing unknown counts as none."""
    return ratio(n, known + F.coalesce(unknown, F.lit(0)))


def share_columns(male: str = "de_male", female: str = "de_female", unknown: str = "de_unknown", young: tuple[str, ...] = ("de_age_18_24", "de_age_25_34"), adult: tuple[str, ...] = ("de_age_18_24", "de_age_25_34", "de_age_35_44", "de_age_45_54", "de_age_55_64", "de_age_65_plus"), age_unknown: str = "de_age_unknown") -> dict[str, Column]:
    """Denominators, shares, usable flags and unknown flags of one row's reach columns."""
    c = F.col
    known, adults = c(male) + c(female), all_sum([c(a) for a in adult])
    return {
        "known_gender_reach": known, "known_adult_reach": adults,
        "female_delivery_share": ratio(c(female), known), "adult_18_34_share": ratio(all_sum([c(a) for a in young]), adults),
        "gender_data_usable": usable(known), "age_data_usable": usable(adults),
        "has_unknown_gender": unknown_flag(c(unknown)), "has_unknown_age": unknown_flag(c(age_unknown)),
    }


def candidate_score(name: Column, count: Column, accepted: list[str], rejected: list[str]) -> Column:
    """name and the terms are normalised (normalise_d). 1000 if equal to an accepted name; each accepted name within it adds 250, and 150 if its tokens are all there; up to 500 ads add thousandths. A rejected term within it makes the score -10000."""
    tokens = F.split(name, " ")
    each = [F.when(name.contains(a), 250.0).otherwise(0.0) + F.when(F.size(F.array_except(F.split(F.lit(a), " "), tokens)) == 0, 150.0).otherwise(0.0) for a in accepted if a]
    total = F.when(name.isin(*accepted), 1000.0).otherwise(0.0) + reduce(add, each, F.lit(0.0)) + F.least(count, F.lit(500)) / 1000.0
    return F.when(F.exists(F.array(*[F.lit(r) for r in rejected]), lambda r: name.contains(r)), -10000.0).otherwise(total) if rejected else total
