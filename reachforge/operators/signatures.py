"""Signature groups, structural conflicts within them, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def collapse_to_signatures(rows: DataFrame, signature: str, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """One row a signature: columns of its first row, number of distinct ids, and the ids in order, joined by bars."""
    first = F.min_by(F.struct(*keep), F.struct(*order, key))
    ids = F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), "|")
    g = rows.groupBy(signature).agg(first.alias("_f"), F.countDistinct(key).alias("n_ids"), ids.alias("ids"))
    return g.select(signature, "_f.*", "n_ids", "ids")


def group_sizes(rows: DataFrame, signature: str) -> DataFrame:
    """How many signatures have how many rows."""
    return rows.groupBy(signature).agg(F.count(F.lit(1)).alias("group_size")).groupBy("group_size").agg(F.count(F.lit(1)).alias("n_signatures"))


def conflicts(rows: DataFrame, signature: str, fields: dict[str, Column]) -> DataFrame:
    """(signature, signature_group_size, conflict_fields) of groups in which a field has several values, null counting as blank; fields in the given order."""
    values = rows.select(signature, *[F.coalesce(x, F.lit("")).alias(f) for f, x in fields.items()])
    # a field differs where its least and greatest value do: partial aggregation, no distinct sets
    g = values.groupBy(signature).agg(F.count(F.lit(1)).alias("signature_group_size"), *[(F.min(f) != F.max(f)).alias(f) for f in fields])
    text = F.concat_ws("|", *[F.when(F.col(f), F.lit(f)) for f in fields])
    return g.select(signature, "signature_group_size", text.alias("conflict_fields")).where("conflict_fields != ''")


def conflict_rows(rows: DataFrame, signature: str, fields: dict[str, Column]) -> DataFrame:
    """All rows of groups with a conflict."""
    return rows.join(conflicts(rows, signature, fields), signature)


def conflict_summary(groups: DataFrame, brand: str | None = None) -> DataFrame:
    """(summary_type, category, n_conflicting_signature_groups): by pattern, and by brand if the groups carry one."""
    one = lambda kind, c, blank: groups.groupBy(F.lit(kind).alias("summary_type"), F.when(F.trim(F.coalesce(c, F.lit(""))) == "", blank).otherwise(F.trim(c)).alias("category")).agg(F.count(F.lit(1)).alias("n_conflicting_signature_groups"))
    out = one("conflict_pattern", F.col("conflict_fields"), "<none>")
    return out.unionByName(one("brand", F.col(brand), "<missing>")) if brand else out


def with_group_size(rows: DataFrame, signature: str) -> DataFrame:
    return rows.withColumn("signature_group_size", F.count(F.lit(1)).over(Window.partitionBy(signature)))
