"""Helpers that several operators share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the word pattern [^\x20\x09-\x0D]+ leaves it out.
SPACE = r"[ \t-\r]"
#: Sorts rows without an id after all others.
LAST_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local one is set only where the session has none and runs on this machine alone; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    ctx = spark.sparkContext
    if ctx.getCheckpointDir() is None:
        if found is None and not ctx.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        ctx.setCheckpointDir(found or tempfile.mkdtemp(prefix="reachforge-"))
    return found or ctx.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Rows that a task takes on of a table that may be small, and the fewest tasks.
ROWS_A_TASK, FEWEST = 50_000, 8


def tasks_for(rows: int) -> int:
    return max(FEWEST, rows // ROWS_A_TASK)


def cut_few(df: DataFrame) -> DataFrame:
    """cut, for a table that may be small: it is read back in as many tasks as its rows need, so that the shuffles after it write few files. A large table stays as it is."""
    done = cut(df)
    return done.coalesce(tasks_for(done.count()))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(batch, column: int, most: int):
    """Slices of an Arrow batch, each ended by the text with which that column reaches so many characters."""
    import pyarrow.compute as pc

    start = size = 0
    for i, length in enumerate(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()):
        size += length
        if size >= most or i == batch.num_rows - 1:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0


def whole(text: str | Column = "text") -> Column:
    """The text; empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identifies a document by id and content: rows that repeat both are one document, and rows without an id sort last."""
    return F.struct(F.coalesce(F.col(doc_id), F.lit(LAST_ID)).alias("id"), F.xxhash64(whole(text)).alias("a"), F.xxhash64(F.lit(1), whole(text)).alias("b"))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often `use` refers to it, also inside its own lambda functions."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))  # a function of one parameter: transform would give a second one the index


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
