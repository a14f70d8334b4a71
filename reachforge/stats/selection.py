"""Exact quantiles of large groups by counting: memory does not grow with the values of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settled

#: Parts into which an interval is cut in a round.
PARTS = 1024


def ranks(probabilities: list[float]) -> list[str]:
    return [f"CAST({f}({p!r}D * (n - 1)) AS BIGINT)" for p in probabilities for f in ("floor", "ceil")]


def selected(df: DataFrame, y: str, by: list[str], sizes: DataFrame, probabilities: list[float]) -> DataFrame:
    """(by, place, value): of each group the values at the places of `ranks`, counted from 0. sizes: (by, n, low, high) of each group.

    Each wanted place begins with the interval of its whole group. In a round, the intervals are cut into PARTS equal parts, of the
    values and of their logarithms by turns, so that neither close nor very unlike values take many rounds. The rows in each part are
    counted, with its least and greatest value; the part that holds the place becomes its interval, and both bounds are values of the
    group. A part can only be smaller than its interval, so in the end an interval is one value. What is shuffled in a round is at most
    PARTS rows for each interval and task; an interval that several places share is counted once. Null groups are groups."""
    places = sizes.select(*by, "low", "high", F.explode(F.array_distinct(F.array(*map(F.expr, ranks(probabilities))))).alias("place")).withColumn("below", F.lit(0).cast("long"))
    places = settled(places)
    out, by_size = None, False
    while True:
        ended = places.where("low = high").select(*by, "place", F.col("low").alias("value"))
        out = ended if out is None else out.unionByName(ended)
        open_ = places.where("low < high")
        if open_.isEmpty():
            return out
        intervals = open_.select(*by, "low", "high").distinct()
        x, low, high = F.col(y), F.col("low"), F.col("high")
        # halves, so that no difference overflows; the bounds are in the first and the last part whatever rounding does, also where it makes their distance 0
        of = (lambda c: F.when(c == 0, 0.0).otherwise(F.signum(c) * (F.ln(F.abs(c)) + 746))) if by_size else (lambda c: c)  # 746: over the logarithm of the least number
        share = F.coalesce(F.try_divide(of(x) / 2 - of(low) / 2, of(high) / 2 - of(low) / 2), F.lit(0.0))
        by_size = not by_size
        part = F.when(x == low, 0).when(x == high, PARTS - 1).otherwise(F.least(F.greatest(F.floor(share * PARTS), F.lit(0)), F.lit(PARTS - 1))).cast("int")
        i = intervals.select(*[F.col(c).alias(f"_{c}") for c in by], "low", "high")
        inside = df.join(i, [df[c].eqNullSafe(i[f"_{c}"]) for c in by] + [df[y] >= i["low"], df[y] <= i["high"]]).select(*by, "low", "high", y)
        counted = inside.groupBy(*by, "low", "high", part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min(y).alias("least"), F.max(y).alias("most"))
        w = Window.partitionBy(*by, "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        counted = counted.withColumn("upto", F.sum("rows").over(w)).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("low").alias("_low"), F.col("high").alias("_high"), "rows", "least", "most", "upto")
        own = open_.join(counted, [open_[c].eqNullSafe(counted[f"_{c}"]) for c in by] + [open_["low"] == counted["_low"], open_["high"] == counted["_high"]])
        held = own.where((F.col("place") - F.col("below") >= F.col("upto") - F.col("rows")) & (F.col("place") - F.col("below") < F.col("upto")))
        places = settled(held.select(*by, F.col("least").alias("low"), F.col("most").alias("high"), "place", (F.col("below") + F.col("upto") - F.col("rows")).alias("below")))


def quantile_columns(df: DataFrame, y: str, by: list[str], sizes: DataFrame, probabilities: list[float]) -> DataFrame:
    """(by, q): an array of the quantiles, interpolated between the two nearest values."""
    found = selected(df, y, by, sizes, probabilities).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("_at"))
    n = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], "n")
    both = found.join(n, [found[c].eqNullSafe(n[f"_{c}"]) for c in by]) if by else found.join(n, F.lit(True))

    def value(p: float) -> Column:
        at = F.lit(p) * (F.col("n") - 1)
        low, high = F.floor(at), F.ceil(at)
        a, b = F.col("_at")[low], F.col("_at")[high]
        return F.when(low == high, a).otherwise((high - at) * a + (at - low) * b)

    return both.select(*by, F.array(*[value(p) for p in probabilities]).alias("q"))
