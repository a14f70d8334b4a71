"""Running sums over a total order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settled


def with_running(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """Adds rank (from 1), running (the sum of value up to and with the row) and total. Rows that tie in the whole order are ranked one after the other.

    Rows are dealt out by ranges of the order, so a range holds what follows the range before; each range is summed up, the sums of the
    ranges before it, one number a range, are its offset, and within a range a window does the rest. The ranges are written before they are
    used twice, as another run could part them elsewhere."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(df.repartitionByRange(tasks, *order).withColumn("_range", F.spark_partition_id()))
    sums = sorted(dealt.groupBy("_range").agg(F.count(F.lit(1)), F.sum(value)).collect())  # a row a range
    before, rows, total = [], 0, 0
    for k, n, s in sums:
        before.append((k, rows, total))
        rows, total = rows + n, total + (s or 0)
    kind = dealt.agg(F.sum(value).alias("s")).schema["s"].dataType.simpleString()
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, f"_range int, _rows long, _sum {kind}"))
    w = Window.partitionBy("_range").orderBy(*order)
    local = dealt.withColumns({"_n": F.row_number().over(w), "_s": F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    done = local.join(offsets, "_range").withColumns({"rank": F.col("_rows") + F.col("_n"), "running": F.col("_sum") + F.coalesce("_s", F.lit(0)), "total": F.lit(total).cast(kind)})
    return done.drop("_range", "_n", "_s", "_rows", "_sum")
