"""Exact dedup by content-defined chunk recipes. DataFrame functions only.

Texts are equal when they are identical without white space. Such a text is cut into chunks at places that its content alone
decides: a chunk ends with the first sentence mark after LEAST characters, or when MORE have followed without one. Its recipe is the ordered list
of its chunks' identifiers, so equal texts are texts of equal recipes.

An identifier is a 64-bit hash that is verified: the chunks are brought together once, copies within a task as one, and the hashes
under which different chunks lie are found. Where a recipe holds such a hash, the chunks stand in the list in place of identifiers.
From there on only recipes move: rows that repeat id, length and recipe become one with a count, each recipe's best row is chosen by
partial aggregation, and the join back has one row a recipe on its right, so adaptive execution can split a recipe of very many rows.

Defined results: a null text is empty; empty texts and texts of white space are equal; of equal texts the row with the most code
points in the original stays, then that with the smallest doc_id, rows without doc_id last; of rows that tie in both exactly one
stays; no rows give none; other columns pass through unchanged, whatever their names; a very long text is one row in the scan and a list of
identifiers from there on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, cut, let, whole

#: Characters after which a chunk ends at the next sentence mark, and how many more it takes to end without one.
LEAST, MORE = 512, 7680
MARKS = ".!?…。！？"
#: Bits of a chunk's hash.
BITS = 64


def normal(text: str | Column = "text") -> Column:
    """The text without white space; null is empty."""
    return F.regexp_replace(whole(text), r"[ \t-\r]+", "")


def chunks(plain: Column) -> Column:
    """The chunks of a text without white space, in order; together they are the text."""
    return F.regexp_extract_all(plain, F.lit(f"(?s).{{1,{LEAST}}}+[^{MARKS}]{{0,{MORE}}}+.?"), F.lit(0))


def identifier(chunk: Column, bits: int = BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def chunk_store(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(id, chunk): every distinct chunk once. Texts can be rebuilt from it and their recipes."""
    every = docs.select(F.explode(chunks(normal())).alias("chunk"))
    return every.select(identifier(F.col("chunk"), bits).alias("id"), "chunk").distinct()


def ambiguous(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """(id): the identifiers that stand for several chunks."""
    return chunk_store(docs, bits).groupBy("id").count().where("count > 1").select("id")


def recipes(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per row: _row with all its columns, its recipe, and the chunks themselves where the recipe alone cannot tell them (else null)."""
    every = let(normal(), lambda plain: F.struct(plain.alias("plain"), F.transform(chunks(plain), lambda c: identifier(c, bits)).alias("recipe")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), every.alias("made")).select("_row", F.col("made.recipe").alias("recipe"), F.unhex(F.sha2(F.col("made.plain"), 256)).alias("sha"))
    unclear = cut(ambiguous(docs, bits))
    if unclear.isEmpty():
        return rows.withColumn("exactly", F.lit(None).cast("array<string>"))
    listed = rows.select("recipe").distinct()
    doubtful = listed.select("recipe", F.explode("recipe").alias("id")).join(unclear, "id").select("recipe").distinct()
    marked = rows.join(doubtful.withColumn("doubtful", F.lit(True)), "recipe", "left")
    return marked.select("_row", "recipe", "sha", F.when(F.col("doubtful"), chunks(normal(F.col("_row.text")))).alias("exactly"))


def _ranked(rows: DataFrame) -> DataFrame:
    """With what decides between rows of a recipe: the smallest (less, id) stays."""
    return rows.withColumn("less", -F.length(whole(F.col("_row.text"))).cast("long")).withColumn("id", F.coalesce(F.col("_row.doc_id").cast("long"), F.lit(LAST_ID)))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (recipe, exactly, sha, id, less) with their number of rows; and of each recipe the best one with all rows' number."""
    own = rows.groupBy("recipe", "exactly", "sha", "id", "less", F.col("_row.doc_id").isNull().alias("none")).agg(F.count(F.lit(1)).alias("rows"))
    best = own.groupBy("recipe", "exactly").agg(F.min(F.struct("less", "id", "none")).alias("best"), F.sum("rows").alias("group_size"), F.first("sha").alias("sha"))
    return own, best


def _together(left: DataFrame, best: DataFrame) -> DataFrame:
    """Joined on the digest too: best is dealt by recipe, so both sides are dealt anew, and adaptive execution can split the left one."""
    same = left["recipe"].eqNullSafe(best["recipe"]) & left["exactly"].eqNullSafe(best["exactly"]) & (left["sha"] == best["sha"])
    return left.join(best, same).select(left["*"], best["best"], best["group_size"])


def dedup_report(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Per row: doc_id, keep_id (of the row that stays), group_size, kept, text_sha256 of the text without white space."""
    own, best = _classes(_ranked(recipes(docs, bits)))
    stays = F.struct("less", "id", "none") == F.col("best")
    known = lambda i, none: F.when(~none, i)
    each = _together(own, best).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("k"))
    return each.select(known(F.col("id"), F.col("none")).alias("doc_id"), known(F.col("best.id"), F.col("best.none")).alias("keep_id"), "group_size", (stays & (F.col("k") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def dedup_documents(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row of each group of equal texts, all columns. Only rows that may stay are moved whole."""
    rows = _ranked(recipes(docs, bits))
    found = _together(rows, _classes(rows)[1])
    one = found.where((F.col("less") == F.col("best.less")) & (F.col("id") == F.col("best.id"))).groupBy("recipe", "exactly").agg(F.first("_row").alias("_row"))
    return one.select("_row.*")
