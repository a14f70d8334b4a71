"""Calendar dates: no time zone is ever applied."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


#: A time of day after any one character, with an offset; or nothing.
TIME = r"(?:.(?:[01]\d|2[0-3])(?::?[0-5]\d(?::?[0-5]\d(?:[.,]\d+)?)?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?)?"
#: Year, week and day of the week, which is Monday where it is left out.
WEEK = rf"^(\d{{4}})(?:-W(\d{{2}})(?:-([1-7]))?|W(\d{{2}})([1-7])?){TIME}$"


def date_only(c: Column) -> Column:
    """The local date of an ISO text (calendar or week dates, with or without hyphens), else that of its first 10 characters, else null."""
    s = F.trim(c)
    first = F.substring(s, 1, 10)
    return F.when(s.rlike(rf"^\d{{8}}{TIME}$"), F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)).try_cast("date")).when(s.rlike(WEEK), week_date(s)).when(first.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), first.try_cast("date"))


def week_date(s: Column) -> Column:
    """The date of an ISO week date; weeks that the year does not have are null."""
    part = lambda *ks: F.nullif(F.concat(*[F.regexp_extract(s, WEEK, k) for k in ks]), F.lit("")).cast("int")
    year, week, day = part(1), part(2, 4), F.coalesce(part(3, 5), F.lit(1))
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in week 1
    monday = F.date_sub(fourth, F.weekday(fourth))
    found = F.date_add(monday, (7 * (week - 1) + day - 1).cast("int"))
    # a week is of the year that holds its Thursday
    thursday = F.date_add(monday, (7 * (week - 1) + 3).cast("int"))
    return F.when((week >= 1) & (F.year(thursday) == year), found)


def month(c: Column) -> Column:
    """Year and month of the first 10 characters, or null."""
    first = F.substring(F.trim(c), 1, 10)
    return F.when(first.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.date_format(first.try_cast("date"), "yyyy-MM"))


def window_class(d: Column, start: str, end: str, words: tuple[str, str, str, str] = ("missing", "before", "inside", "after")) -> Column:
    """Missing, before, inside (both ends count) or after."""
    return F.when(d.isNull(), words[0]).when(d < F.lit(start).cast("date"), words[1]).when(d > F.lit(end).cast("date"), words[3]).otherwise(words[2])


def bisect(start: date, end: date) -> list[tuple[date, date]]:
    """Halves of a closed date range; a single day cannot be split."""
    if start >= end:
        raise ValueError("a single day cannot be split")
    mid = start + timedelta(days=(end - start).days // 2)
    return [(start, mid), (mid + timedelta(days=1), end)]


def bisect_columns(start: Column, end: Column) -> tuple[Column, Column]:
    """The same as columns: the end of the first half and the start of the second."""
    mid = F.date_add(start, F.floor(F.datediff(end, start) / 2).cast("int"))
    return mid, F.date_add(mid, 1)
