"""Collapses ads to configurations, and derives shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.dates import month
from ..functions.scalars import age_scope, platform_category, share_columns
from .checks import assert_constant_in_group


def collapse(rows: DataFrame, key: list[str], constant: list[str], measures: list[str], id_column: str, count_name: str = "configuration_ad_id_count") -> DataFrame:
    """One row a key: columns that are constant within it, distinct ids, and sums that are null only if all parts are. One aggregation does it all."""
    aggs = [*[F.min(c).alias(c) for c in constant], F.countDistinct(id_column).alias(count_name), *[F.sum(m).alias(m) for m in measures]]
    return rows.groupBy(*key).agg(*aggs)


def configurations(rows: DataFrame) -> DataFrame:
    return collapse(rows, S.CONFIG_KEY, ["search_brand", "sector", "age_scope"], S.REACH, "meta_ad_id").withColumns(share_columns())


def verify(rows: DataFrame) -> None:
    assert_constant_in_group(rows, S.CONFIG_KEY, ["search_brand", "sector", "age_scope"])


def collapse_summary(config: DataFrame, count_name: str = "configuration_ad_id_count") -> DataFrame:
    n = F.col(count_name)
    return config.agg(F.count(F.lit(1)).alias("configurations"), F.count_if(n == 1).alias("singletons"), F.count_if(n > 1).alias("repeated"), F.sum(F.when(n > 1, n).otherwise(0)).alias("ids_in_repeated"), F.max(n).alias("largest"), F.sum(n - 1).alias("collapsed"))


def derive(rows: DataFrame) -> DataFrame:
    """Shares, flags, scope, platform category and month of each ad; reach columns are text in bronze and whole numbers here."""
    typed = rows.withColumns({c: F.trim(F.col(c).cast("string")).try_cast("long") for c in S.REACH})
    return typed.withColumns(share_columns() | {"age_scope": age_scope(F.col("target_ages")), "platform_category": platform_category(F.col(S.PLATFORMS)), "month": month(F.col(S.START))})
