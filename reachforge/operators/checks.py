"""Expectations. Each raises ValueError with what it found, after one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """At plan time; nothing runs."""
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def assert_schema(df: DataFrame, names: list[str]) -> DataFrame:
    if df.columns != names:
        raise ValueError(f"columns are {df.columns}, not {names}")
    return df


def expect_count(df: DataFrame, n: int) -> DataFrame:
    if (found := df.count()) != n:
        raise ValueError(f"{found} rows, not {n}")
    return df


def assert_none(df: DataFrame, bad: Column, what: str) -> DataFrame:
    if found := df.where(bad).count():
        raise ValueError(f"{found} rows: {what}")
    return df


def assert_unique(df: DataFrame, *key: str) -> DataFrame:
    blank = " OR ".join(f"`{k}` IS NULL OR trim(CAST(`{k}` AS string)) = ''" for k in key)
    if df.where(blank).limit(1).count():
        raise ValueError(f"blank {key}")
    if df.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated {key}")
    return df


def assert_subset(a: DataFrame, b: DataFrame, key: str) -> None:
    if n := a.select(key).join(b.select(key), key, "left_anti").count():
        raise ValueError(f"{n} {key} are not in the other table")


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    if n := a.select(key).join(b.select(key), key, "left_semi").count():
        raise ValueError(f"{n} {key} are in both tables")


def inconsistent(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The groups in which a column has more than one value, with the number of values of each; null counts as blank."""
    n = df.groupBy(*key).agg(*[F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])
    return n.where(" OR ".join(f"`{c}` > 1" for c in columns))


def assert_constant_in_group(df: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    if found := inconsistent(df, key, columns).count():
        raise ValueError(f"{found} groups: {columns} differ within {key}")
    return df


def count_matches(written: DataFrame, noted: DataFrame) -> DataFrame:
    """(written, counted, same) of a table and the one-row count (counted) that its writer noted."""
    return written.agg(F.count(F.lit(1)).alias("written")).join(noted.select("counted"), F.lit(True)).select("written", "counted", (F.col("written") == F.col("counted")).alias("same"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted; the check after a write."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def expectations(df: DataFrame, metrics: dict[str, Column], expected: dict[str, float]) -> DataFrame:
    """(metric, value, expected, ok) of aggregates, in one pass."""
    wide = df.agg(*[m.cast("double").alias(k) for k, m in metrics.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(float(expected[k])).alias("expected")) for k in metrics]))
    return wide.select(rows.alias("r")).select("r.*").withColumn("ok", F.col("value") == F.col("expected"))
