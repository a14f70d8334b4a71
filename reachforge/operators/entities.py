"""Entity resolution of pages: tallies, scored candidates, ambiguity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tally(hits: DataFrame, page: str | list[str] = "page_id", name: str = "page_name", seq: str | Column = "_seq") -> DataFrame:
    """Ads by page, with the name seen last."""
    return hits.groupBy(*([page] if isinstance(page, str) else page)).agg(F.count(F.lit(1)).alias("ad_count"), F.max_by(name, seq).alias(name))


def top_candidates(scored: DataFrame, by: str, score: str, tie: list[str], k: int = 8, least: float = 100.0) -> DataFrame:
    """The k best of each group, whether the best score is tied, and whether it is good enough."""
    w = Window.partitionBy(by).orderBy(F.desc(score), *tie)
    best = F.max(score).over(Window.partitionBy(by))
    ranked = scored.withColumn("_best", best).withColumn("rank", F.row_number().over(w).cast("long")).withColumn("_tied", F.count(F.when(F.col(score) == F.col("_best"), 1)).over(Window.partitionBy(by)))
    return ranked.where(F.col("rank") <= k).withColumn("ambiguous", F.col("_tied") > 1).withColumn("accepted", (F.col("_best") >= least) & (F.col("_tied") == 1) & (F.col("rank") == 1)).drop("_best", "_tied")
