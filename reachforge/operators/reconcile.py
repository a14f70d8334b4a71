"""Reconciles several versions of one id: the latest row, its parts from other versions, drift and conflicts. One window pass and one aggregate."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.jsonlist import parse, same_list, same_text


def latest(rows: DataFrame, key: list[str], order: list[Column], first: Column | None = None) -> DataFrame:
    """One row a key: the first in the given order (rows with `first` before all others)."""
    w = Window.partitionBy(*key).orderBy(*([F.desc(first.cast("int"))] if first is not None else []), *order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def union_of_lists(lists: Column) -> Column:
    """The distinct items of a group's arrays, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(lists))))


def changes(rows: DataFrame, key: list[str], order: list[Column], fields: dict[str, str], same: dict[str, object] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Each change of a field between a version and the one before: key, difference_tier, differing_field, earlier_value, later_value and carried columns of both. fields: field to tier."""
    same, carry = same or {}, carry or []
    w = Window.partitionBy(*key).orderBy(*order)
    pair = rows.withColumn("_before", F.lag(F.struct(*dict.fromkeys([*fields, *carry]))).over(w)).where("_before IS NOT NULL")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))

    def one(f: str, tier: str) -> Column:
        a, b = F.col("_before")[f], F.col(f)
        differs = ~(same[f](a, b) if f in same else same_text(a.cast("string"), b.cast("string")))
        return F.when(differs, F.struct(F.lit(tier).alias("difference_tier"), F.lit(f).alias("differing_field"), text(a).alias("earlier_value"), text(b).alias("later_value")))

    found = F.filter(F.array(*[one(f, t) for f, t in fields.items()]), lambda x: x.isNotNull())
    both = [c for name in carry for c in (F.col("_before")[name].alias(f"earlier_{name}"), F.col(name).alias(f"later_{name}"))]
    return pair.select(*key, *both, F.explode(found).alias("_d")).select(*key, "_d.*", *[x for name in carry for x in (f"earlier_{name}", f"later_{name}")])


def drifted(rows: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys whose versions differ in these values."""
    v = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in values])
    return rows.groupBy(*key).agg(F.min(v).alias("a"), F.max(v).alias("b"), F.count(F.lit(1)).alias("n_versions")).where("a != b").select(*key, "n_versions")


ORDER = ("collection_timestamp", "_query_date_min", "_query_date_max", "_seq")


def reconcile(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(final rows, conflicts, delivery versions) of raw rows with _query_date_min, _query_date_max and _seq.

    Of equal timestamps the first in segment order counts as latest. Ids with one version pass through unchanged."""
    key = ["search_brand", "meta_ad_id"]
    backward = [F.desc("collection_timestamp"), F.col("_query_date_min"), F.col("_query_date_max"), F.col("_seq")]
    forward = [F.col(c) for c in ORDER]
    w = Window.partitionBy(*key)
    there = reduce(or_, [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in S.REACH])
    stop = F.trim(F.coalesce(F.col(S.STOP), F.lit("")))
    versions = F.count(F.lit(1)).over(w)
    pick = lambda first, value: F.first_value(value).over(w.orderBy(F.desc(first.cast("int")), *backward).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    row_k = F.row_number().over(w.orderBy(*backward))
    reach = pick(there, F.struct(*S.REACH))
    platforms = F.array_sort(F.array_distinct(F.flatten(F.collect_set(parse(F.col(S.PLATFORMS), "drop")).over(w))))
    full = rows.withColumns({"_n": versions, "_k": row_k, "_reach": reach, "_stop": pick(stop != "", F.col(S.STOP)), "_platforms": platforms}).where("_k = 1")
    many = F.col("_n") > 1
    swap = {c: F.when(many, F.col("_reach")[c]).otherwise(F.col(c)) for c in S.REACH} | {S.STOP: F.when(many, F.col("_stop")).otherwise(F.col(S.STOP)), S.PLATFORMS: F.when(many, F.to_json("_platforms")).otherwise(F.col(S.PLATFORMS))}
    final = full.withColumns(swap).select(*S.RAW)
    fields = {c: "creative" for c in S.CREATIVE} | {c: "targeting" for c in S.TARGETING} | {S.START: "start_date_time"}
    lists = {c: same_list for c in [*S.CREATIVE, "target_ages"]}
    conflict = changes(rows, key, forward, fields, lists, ["collection_timestamp", "_query_date_min", "_query_date_max"])
    conflict = conflict.withColumnsRenamed({f"{a}_{n}": f"{a}{n}" for a in ("earlier", "later") for n in ("_query_date_min", "_query_date_max")}).select(*S.CONFLICT)
    delivery = rows.join(drifted(rows, key, [S.STOP, *S.REACH]).select(*key), key, "left_semi").select(F.col("_query_date_min").alias("query_date_min"), F.col("_query_date_max").alias("query_date_max"), *S.RAW)
    return final, conflict, delivery
