"""Locks the eligible rows: anti joins, set checks and the exclusion ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checks import assert_disjoint, assert_subset, assert_unique, require_columns


def noncommercial(decisions: DataFrame) -> DataFrame:
    """Manual decisions to exclude; the last row of an id wins, in the order of _seq."""
    require_columns(decisions, ["meta_ad_id", "final_classification", "_seq"])
    last = decisions.withColumn("_k", F.row_number().over(Window.partitionBy("meta_ad_id").orderBy(F.desc("_seq")))).where("_k = 1").drop("_k")
    return last.where(F.lower(F.trim("final_classification")) == "noncommercial")


def lock(rows: DataFrame, automatic: DataFrame, manual: DataFrame, key: str = "meta_ad_id") -> DataFrame:
    """The rows in neither set of ids."""
    return rows.join(automatic.select(key), key, "left_anti").join(manual.select(key), key, "left_anti")


def ledger(rows: DataFrame, automatic: DataFrame, manual: DataFrame, key: str = "meta_ad_id") -> DataFrame:
    """Every exclusion with its stage, reason and rule. An excluded id that no row has is an error at run time."""
    brand = rows.select(key, "search_brand", "sector", F.lit(True).alias("_known"))
    auto = automatic.select(key, F.lit("automatic").alias("exclusion_stage"), F.col("eligibility_reason").alias("exclusion_reason"), F.col("matched_rule").alias("exclusion_rule"), F.lit("").alias("manual_category"))
    hand = manual.select(key, F.lit("manual").alias("exclusion_stage"), F.lit("manual_review").alias("exclusion_reason"), F.lit("").alias("exclusion_rule"), F.col("final_manual_category").alias("manual_category"))
    every = auto.unionByName(hand).join(brand, key, "left")
    known = F.coalesce("_known", F.raise_error(F.concat(F.lit("excluded id without a row: "), F.coalesce(F.col(key).cast("string"), F.lit("<null>")))).cast("boolean"))
    return every.where(known).select(key, "search_brand", "sector", "exclusion_stage", "exclusion_reason", "exclusion_rule", "manual_category")


def verify(rows: DataFrame, automatic: DataFrame, manual: DataFrame, key: str = "meta_ad_id") -> None:
    """Ids are unique, excluded ids are known, and no id is excluded twice."""
    assert_unique(rows, key)
    assert_subset(automatic, rows, key)
    assert_subset(manual, rows, key)
    assert_disjoint(automatic, manual, key)


def with_page_id(rows: DataFrame, retailers: DataFrame) -> DataFrame:
    """Adds the retailer's page id; the dimension has a row a retailer. Unknown retailers are an error at run time."""
    joined = rows.join(retailers.select("search_brand", "page_id"), "search_brand", "left")
    return joined.withColumn("page_id", F.coalesce("page_id", F.raise_error(F.concat(F.lit("unknown retailer: "), F.coalesce("search_brand", F.lit("<null>"))))))
