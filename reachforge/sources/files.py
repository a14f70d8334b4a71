"""CSV, JSON and Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.checks import require_columns, same_rows
from ..schemas import strings

QUOTED = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str], required: list[str] | None = None) -> DataFrame:
    """Text columns; quoted line breaks and doubled quotes; a byte order mark is skipped. The header must hold the columns in their order."""
    df = spark.read.schema(strings(columns)).options(**QUOTED, enforceSchema=False).csv(path)
    return require_columns(df, required or columns)


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """With declared types in place of inferred ones; NA, None and null are missing."""
    raw = spark.read.schema(strings(schema.names)).options(**QUOTED, enforceSchema=False).csv(path)
    clean = lambda f: F.when(~F.col(f.name).isin("NA", "None", "null", "NaN", "nan", ""), F.col(f.name)).try_cast(f.dataType)
    return raw.select(*[clean(f).alias(f.name) for f in schema])


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed order; columns that are not named are left out; nulls are blank; spaces at the ends of a text stay."""
    df.select(*[F.col(c).cast("string") for c in columns]).write.mode("overwrite").options(header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_verified(df: DataFrame, path: str, columns: list[str] | None = None) -> DataFrame:
    """Writes Parquet, reads it again and compares it to the source; the committer makes the write atomic."""
    out = df.select(*(columns or df.columns))
    out.write.mode("overwrite").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if not same_rows(back, out):
        raise ValueError(f"what was written to {path} differs from its source")
    return back


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """One folder a value; large values are split over tasks, small ones share them."""
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)


def union_in_order(parts: list[tuple[int, DataFrame]], seq: str = "_part") -> DataFrame:
    """All rows of several tables, each with its place in the declared order."""
    out = None
    for k, df in parts:
        df = df.withColumn(seq, F.lit(k))
        out = df if out is None else out.unionByName(df)
    return out


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
