"""Data-quality profile and conditional counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import blank, number


def identity_profile(df: DataFrame, *key: str) -> DataFrame:
    """Rows, distinct ids, ids that repeat and rows beyond the first of each."""
    ids = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return ids.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("extra_rows"))


def counters(df: DataFrame, tests: dict[str, Column], by: str | None = None, total: str = "<all>") -> DataFrame:
    """Counts of rows that pass each test, in all and by a column, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), *[F.count_if(t).alias(k) for k, t in tests.items()]]
    if by is None:
        return df.agg(*aggs)
    return df.rollup(by).agg(F.grouping(by).alias("_g"), *aggs).withColumn(by, F.when(F.col("_g") == 1, total).otherwise(F.col(by))).drop("_g")


def validity(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_blank, n_invalid, n_negative, n_fraction) of text columns that should be counts."""
    def one(c: str) -> Column:
        x, there = number(F.col(c)), ~blank(F.col(c))
        return F.struct(F.lit(c).alias("column"), F.count_if(~there).alias("n_blank"), F.count_if(there & x.isNull()).alias("n_invalid"), F.count_if(x < 0).alias("n_negative"), F.count_if(x != F.floor(x)).alias("n_fraction"))

    return df.agg(F.array(*[one(c) for c in columns]).alias("r")).select(F.inline("r"))


def reconciliation(df: DataFrame, left: Column, right: Column, by: str | None = None) -> DataFrame:
    """Rows whose two totals agree and differ; rows without one of them are neither."""
    return counters(df, {"matches": left == right, "mismatches": left != right}, by)


def long_form(wide: DataFrame, notes: dict[str, str] | None = None) -> DataFrame:
    """(metric, value, note) of a one-row table."""
    notes = notes or {}
    row = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value"), F.lit(notes.get(c, "")).alias("note")) for c in wide.columns])
    return wide.select(F.inline(row))


def class_counts(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Rows by class, in all and by each column, as (kind, key, label, n): one pass with grouping sets."""
    by = by or []
    sets = ", ".join(["(`%s`)" % label, *[f"(`{b}`, `{label}`)" for b in by]])
    view = df.select(label, *by)
    keys = F.coalesce(*[F.when(F.col(f"_g_{b}") == 0, F.coalesce(F.col(b).cast("string"), F.lit("<missing>"))) for b in by], F.lit("<all>")) if by else F.lit("<all>")
    kind = F.coalesce(*[F.when(F.col(f"_g_{b}") == 0, F.lit(b)) for b in by], F.lit("total")) if by else F.lit("total")
    cols = ", ".join([f"`{label}`", *[f"`{b}`" for b in by]])
    marks = "".join(f", grouping(`{b}`) AS `_g_{b}`" for b in by)
    out = view.sparkSession.sql(f"SELECT {cols}{marks}, count(*) AS n FROM {{v}} GROUP BY GROUPING SETS ({sets})", v=view)
    return out.select(kind.alias("kind"), keys.alias("key"), F.col(label).alias("label"), "n")


def audit_profile(conflicts: DataFrame, tier: str = "difference_tier", field: str = "differing_field", key: str = "meta_ad_id") -> DataFrame:
    """(kind, label, n): conflict rows, their ids, and rows by tier and by field; blank ones are left out of the latter."""
    base = conflicts.agg(F.count(F.lit(1)).alias("conflict_rows"), F.countDistinct(key).alias("conflict_ids"))
    total = base.select(F.inline(F.array(*[F.struct(F.lit("total").alias("kind"), F.lit(c).alias("label"), F.col(c).alias("n")) for c in base.columns])))
    by = lambda c: conflicts.where(~blank(F.col(c))).groupBy(F.lit(c).alias("kind"), F.col(c).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return total.unionByName(by(tier)).unionByName(by(field))
