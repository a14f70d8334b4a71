"""Audience benchmark: share bounds by scope, and the gaps of observed shares to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Platform category to benchmark scope.
SCOPES = {"Both": "facebook_instagram", "Facebook-only": "facebook_only", "Instagram-only": "instagram_only"}


def share_bounds(benchmark: DataFrame, scope: str = "platform_scope", gender: str = "gender", low: str = "estimate_mau_lower_bound", high: str = "estimate_mau_upper_bound", female: str = "female", male: str = "male") -> DataFrame:
    """By scope: the least and greatest share of the first gender that the bounds allow. A pivoting aggregate, no self-join."""
    of = lambda g, c: F.max(F.when(F.col(gender) == g, F.col(c)))
    g = benchmark.groupBy(scope).agg(of(female, low).alias("fl"), of(female, high).alias("fh"), of(male, low).alias("ml"), of(male, high).alias("mh"))
    return g.select(F.col(scope).alias("benchmark_scope"), (F.col("fl") / (F.col("fl") + F.col("mh"))).alias("benchmark_lower"), (F.col("fh") / (F.col("fh") + F.col("ml"))).alias("benchmark_upper"))


def gaps(rows: DataFrame, bounds: DataFrame, scope: Column, share: str, by: str) -> DataFrame:
    """By group, in percentage points: the mean share, and its mean signed and absolute gaps to both bounds. Rows without a scope are left out."""
    j = rows.withColumn("benchmark_scope", scope).where("benchmark_scope IS NOT NULL").join(bounds, "benchmark_scope", "left")
    x, a, b = F.col(share), F.col("benchmark_lower"), F.col("benchmark_upper")
    mean = lambda c, n: (F.avg(c) * 100).alias(n)
    full = j.where(x.isNotNull() & a.isNotNull() & b.isNotNull())
    return full.groupBy(by).agg(mean(x, "observed_share_percent"), mean(x - a, "signed_gap_lower_pp"), mean(x - b, "signed_gap_upper_pp"), mean(F.abs(x - a), "absolute_gap_lower_pp"), mean(F.abs(x - b), "absolute_gap_upper_pp"))


def scope_of(platform_category: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SCOPES.items() for x in kv])[platform_category]
