"""Exclusion rates, concentration, and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settled
from .running import with_running


def exclusion_rates(df: DataFrame, excluded: Column, by: str) -> DataFrame:
    """By group: rows, exclusions, their rate and the group's share of all exclusions. The total is a window over the few groups."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(excluded).alias("n_excluded"))
    total = F.sum("n_excluded").over(Window.partitionBy())
    return g.select(by, "n_rows", "n_excluded", F.round(100.0 * F.col("n_excluded") / F.col("n_rows"), 4).alias("rate_percent"), F.when(total > 0, F.round(100.0 * F.col("n_excluded") / total, 4)).otherwise(0.0).alias("share_percent"))


def concentration(counts: DataFrame, name: str, n: str) -> DataFrame:
    """Rank by count, then name; with running sums and shares. counts: one row a group, of any number of groups."""
    ranked = with_running(counts.select(name, n), [F.desc(n), F.asc(name)], n)
    return ranked.select(name, n, "rank", "running", F.round(100.0 * F.col("running") / F.col("total"), 4).alias("running_percent"))


def top_share(counts: DataFrame, name: str, n: str, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """The share of the k largest groups, for each k."""
    ranked = concentration(counts, name, n)
    total = F.sum(n)
    return ranked.agg(*[F.round(100.0 * F.sum(F.when(F.col("rank") <= k, F.col(n)).otherwise(0)) / total, 4).alias(f"top_{k}_percent") for k in ks])


def summary_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """(type, label, count, pct) of each column's values, in one pass over the rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("type"), F.coalesce(F.col(c).cast("string"), F.lit("<missing>")).alias("label")) for c in columns])
    g = df.select(F.explode(pairs).alias("p")).groupBy("p.type", "p.label").agg(F.count(F.lit(1)).alias("count"))
    return g.withColumn("pct", F.round(100.0 * F.col("count") / F.sum("count").over(Window.partitionBy("type")), 4))


def sample_order(key: Column, seed: int | str) -> Column:
    """A reproducible random order: the hash of id and seed."""
    return F.sha2(F.concat_ws("|", key.cast("string"), F.lit(str(seed))), 256)


def least_by_cell(rows: DataFrame, order: str, cell: str, per_cell: int, target: int) -> DataFrame:
    """(order, cell): of each cell the per_cell least values of the order, and the least of all, as many as can be among the target least ones that are not of the first kind. A task hands on its own least only, so that many rows of each cell and task are shuffled at most."""

    def run(batches):
        import pandas as pd
        import pyarrow as pa

        held = pd.DataFrame({"o": pd.Series(dtype=str), "cell": pd.Series(dtype=str)})
        for batch in batches:
            new = pd.DataFrame({"o": batch.column(0).to_pylist(), "cell": batch.column(1).to_pylist()})
            every = pd.concat([held, new]).drop_duplicates().sort_values("o", kind="stable")
            of_all = every["o"].ne(every["o"].shift()).cumsum()
            held = every[(every.groupby("cell").cumcount() < per_cell) | (of_all <= target + per_cell * every["cell"].nunique())]
        yield pa.RecordBatch.from_arrays([pa.array(held["o"].tolist(), pa.string()), pa.array(held["cell"].tolist(), pa.string())], [order, cell])

    handed = settled(rows.select(order, cell).mapInArrow(run, f"{order} string, {cell} string").distinct())
    cells = handed.select(cell).distinct().count()
    first = handed.withColumn("_k", F.row_number().over(Window.partitionBy(cell).orderBy(order))).where(F.col("_k") <= per_cell).drop("_k")
    rest = handed.join(handed.select(order).distinct().orderBy(order).limit(target + per_cell * cells), order, "left_semi")
    return settled(first.unionByName(rest).distinct())


def stratified_sample(df: DataFrame, key: str, cells: list[str], per_cell: int, target: int, seed: int = 0) -> DataFrame:
    """Distinct ids: the first per_cell of every cell in hash order, then the first of all the others, target rows in all. The cells' own rows come first when they alone pass the target. Of rows that repeat an id the least by all columns stands for it.

    One scan finds the ids that can be in the sample, by their hashes and cells alone, and a second one their rows. Where an id among them
    has rows in other cells than that of its least row, it may have stood in the way of others; only then all ids are brought together."""
    others = [c for c in df.columns if c != key]
    rows = df.withColumn("_o", sample_order(F.col(key), seed)).withColumn("_cell", F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}))
    least = lambda r: r.groupBy(key, "_o").agg(F.min(F.struct(*others)).alias("_r")).select(key, "_o", *[F.col("_r")[c].alias(c) for c in others])
    asked = least_by_cell(rows, "_o", "_cell", per_cell, target)
    one = settled(least(rows.join(F.broadcast(asked.select("_o").distinct()), "_o", "left_semi").drop("_cell")))  # at most twice per_cell rows of each cell, and target more
    own = one.select("_o", F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}).alias("_own"))
    if not asked.join(own, "_o").where("_cell != _own").isEmpty():
        one = least(rows.drop("_cell"))
    first = one.withColumn("_k", F.row_number().over(Window.partitionBy(*cells).orderBy("_o", key))).where(F.col("_k") <= per_cell).drop("_k")
    rest = one.join(first.select("_o"), "_o", "left_anti").orderBy("_o", key).limit(target)
    both = first.withColumn("_rest", F.lit(False)).unionByName(rest.withColumn("_rest", F.lit(True)))
    return both.orderBy("_rest", *[F.when(~F.col("_rest"), F.col(c)) for c in cells], "_o", key).limit(target).select(*df.columns)


def coverage(sample: DataFrame, full: DataFrame, cells: list[str]) -> DataFrame:
    """Rows by cell in the full table and in the sample."""
    a = full.groupBy(*cells).agg(F.count(F.lit(1)).alias("n_rows"))
    b = sample.groupBy(*cells).agg(F.count(F.lit(1)).alias("n_sampled"))
    return a.join(b, cells, "left").select(*cells, "n_rows", F.coalesce("n_sampled", F.lit(0).cast("long")).alias("n_sampled"))
