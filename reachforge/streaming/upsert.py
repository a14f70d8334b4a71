"""Continuous ingestion of new versions: the latest row of each id, kept by structured streaming state in the output table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reconcile import latest


def upsert_latest(stream: DataFrame, path: str, checkpoint: str, key: list[str], order: list[str], buckets: int = 64) -> StreamingQuery:
    """Each micro-batch is merged into a Parquet table in buckets of the key's hash; only buckets that the batch touches are read and rewritten, each into a new generation that a later read prefers. A batch that is run twice writes its generation anew. Of a rewritten bucket the generation before stays for reads under way; older ones are deleted, so the table holds each row twice at most."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # `buckets` rows at most
        if not touched:
            return
        before = {b: g for b, g in newest(spark, path, number).items() if b in touched}
        if before:
            new = _read(spark, path, before).drop("_generation").unionByName(new)
        first = latest(new, key, [F.desc(c) for c in order])
        first.write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/_generation={number}")
        for generation, bucket in generations(spark, path):
            if bucket in before and generation < before[bucket]:
                _files(spark, path).delete(_hadoop(spark, f"{path}/_generation={generation}/_bucket={bucket}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _hadoop(spark, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark, path: str):
    return _hadoop(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def generations(spark, path: str) -> list[tuple[int, int]]:
    """(generation, bucket) of all that is in the table, in whatever store it is; a generation that was not written to its end is left out."""
    found = _files(spark, path).globStatus(_hadoop(spark, f"{path}/_generation=*/_bucket=*")) or []
    done = {x.getPath().getParent().getName() for x in _files(spark, path).globStatus(_hadoop(spark, f"{path}/_generation=*/_SUCCESS")) or []}
    number = lambda p: int(p.getName().partition("=")[2])
    return [(number(x.getPath().getParent()), number(x.getPath())) for x in found if x.getPath().getParent().getName() in done]


def newest(spark, path: str, under: int | None = None) -> dict[int, int]:
    """By bucket: its newest generation (under the given one)."""
    out: dict[int, int] = {}
    for generation, bucket in generations(spark, path):
        if under is None or generation < under:
            out[bucket] = max(generation, out.get(bucket, generation))
    return out


def _read(spark, path: str, which: dict[int, int]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*[f"{path}/_generation={g}/_bucket={b}" for b, g in sorted(which.items())])


def current(spark, path: str) -> DataFrame:
    """The newest generation of each bucket; no other file is read. Rows that repeat are all there."""
    which = newest(spark, path)
    if not which:
        raise FileNotFoundError(path)
    return _read(spark, path, which)


def windowed_counts(stream: DataFrame, time: str, late: str, width: str, by: list[str]) -> DataFrame:
    """Counts by time window, with a watermark for late rows."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
