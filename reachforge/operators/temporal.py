"""Date-window filter with an account of every excluded row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import window_class


def classify(df: DataFrame, column: str, start: str, end: str, name: str = "window_class") -> DataFrame:
    return df.withColumn(name, window_class(F.col(column).cast("date"), start, end))


def eligible(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows inside the window; a plain range, so that it reaches the scan."""
    return df.where((F.col(column) >= F.lit(start).cast("date")) & (F.col(column) < F.date_add(F.lit(end).cast("date"), 1)))


def summary(df: DataFrame, column: str, start: str, end: str, by: str) -> DataFrame:
    """By group: rows, included, and excluded before, after and without a date; with the share included."""
    c = classify(df, column, start, end)
    one = lambda w: F.count_if(F.col("window_class") == w)
    out = c.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), one("inside").alias("included"), one("before").alias("excluded_before"), one("after").alias("excluded_after"), one("missing").alias("excluded_missing"), F.min(F.col(column).cast("date")).alias("first_date"), F.max(F.col(column).cast("date")).alias("last_date"))
    return out.withColumn("included_percent", F.round(100.0 * F.col("included") / F.col("n_rows"), 4))
