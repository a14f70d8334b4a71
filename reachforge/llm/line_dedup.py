"""Deletes later copies of repeated line runs. DataFrame functions only.

A text is the sequence of its lines that hold a word. The suffixes of all sequences are named by prefix doubling: the name of the
2^(k+1) lines at a place is made of the names of the 2^k lines there and 2^k lines further on. A run that starts at a place and is
as short as min_words allows is named by the two overlapping power-of-two blocks that make it up, so suffixes with that run as
common prefix, an interval of the suffix array, share a name. 128-bit names stand in for ranks: they tell equal from unequal just
so, and cost no sort a round. The same is done backwards. The runs that start or end at some line and have min_words words cover
exactly the maximal repeated runs of at least min_words words, so the lines of those whose first copy is elsewhere are deleted.

The first copy is the one with the smallest (doc_id, content, place); a run may overlap its earlier copy. Only run names and
places are shuffled, with partial aggregation; the join of places to repeated names has one row a name on its right, so adaptive
execution splits hot names.

Defined results: a null text is empty and stays null; lines without a word are neither compared nor counted, and go when every
line with a word went (the text is then empty); rows that repeat doc_id and text are one document, not copies of each other, and
are all edited alike; rows without doc_id come last in order; no rows give none; other columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, row_key, whole

MIN_WORDS = 50


def lines_of(text: Column) -> Column:
    """Lines that hold a word, with their place among all lines from 0, their number of words and their name."""
    every = F.transform(F.split(text, "\n"), lambda s, i: F.struct(i.alias("at"), F.regexp_count(s, F.lit(r"[^ \t-\r]+")).alias("words"), name(s).alias("a")))
    return F.filter(every, lambda x: x["words"] > 0)


def name(*parts: Column) -> Column:
    """128 bits, as two differently seeded 64-bit hashes."""
    return F.struct(F.xxhash64(*parts).alias("x"), F.xxhash64(F.lit(7), *parts).alias("y"))


def doubled(names: Column, step: int) -> Column:
    return let(names, lambda n: F.transform(n, lambda a, i: F.when(i + step < F.size(n), name(a, F.get(n, i + step)))))


def runs(lines: Column, min_words: int) -> Column:
    """From each line on and back from each line: the shortest run of at least min_words words, as its first line s, the line e after its last, and its name."""
    reached = F.lit(min_words)

    def length(words: Column) -> Column:
        """How many of these counts make up min_words, or 0."""
        add = lambda acc, w: F.when(acc["sum"] >= reached, acc).otherwise(F.struct((acc["sum"] + w).alias("sum"), (acc["n"] + 1).alias("n")))
        return F.aggregate(words, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n")), add, lambda acc: F.when(acc["sum"] >= reached, acc["n"]).otherwise(0))

    def bounds(words: Column) -> Column:
        forward = F.transform(words, lambda w, i: let(length(F.slice(words, i + 1, reached)), lambda n: F.struct(i.alias("s"), (i + n).alias("e"))))
        back = F.transform(words, lambda w, i: let(length(F.reverse(F.slice(words, F.greatest(i + 2 - reached, F.lit(1)), F.least(reached, i + 1)))), lambda n: F.struct((i + 1 - n).alias("s"), (i + 1).alias("e"))))
        return F.array_distinct(F.filter(F.concat(forward, back), lambda r: r["e"] > r["s"]))

    def named(levels: list[Column], found: Column, step: int) -> Column:
        """Nests one more level of doubling until blocks of half the longest possible run are named."""
        if 2 * step <= min_words:
            return let(doubled(levels[-1], step), lambda n: named([*levels, n], found, 2 * step))

        def of(r: Column) -> Column:
            out, size = F.lit(None), r["e"] - r["s"]
            for k in reversed(range(len(levels))):
                whole_name = name(size, F.get(levels[k], r["s"]), F.get(levels[k], r["e"] - 2**k))
                out = whole_name if k == len(levels) - 1 else F.when(size < 2 ** (k + 1), whole_name).otherwise(out)
            return F.struct(r["s"].alias("s"), r["e"].alias("e"), out.alias("name"))

        return F.transform(found, of)

    return let(bounds(F.transform(lines, lambda x: x["words"])), lambda found: let(F.transform(lines, lambda x: x["a"]), lambda n: named([n], found, 1)))


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document with such lines: key and the distinct (s, e) of its runs whose first copy is elsewhere."""
    run = docs.select(row_key().alias("key"), F.explode(let(lines_of(whole("text")), lambda ls: runs(ls, min_words))).alias("r")).select("key", "r.s", "r.e", F.col("r.name.x").alias("x"), F.col("r.name.y").alias("y"))
    place = F.struct("key", "s")
    first = run.groupBy("x", "y").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("x", "y", "first")
    later = run.join(first, ["x", "y"]).where(place != F.col("first"))
    return later.groupBy("key").agg(F.collect_set(F.struct("s", "e")).alias("cut"))


def mark_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns, with _gone: the numbers of the deleted lines among the lines with a word (null: none)."""
    gone = F.array_distinct(F.flatten(F.transform("cut", lambda r: F.sequence(r["s"], r["e"] - 1))))
    found = later_copies(docs, min_words).select("key", gone.alias("_gone"))
    # packed, so that no column of the rows can clash with the operator's own
    packed = docs.select(F.struct(*docs.columns).alias("_row"), row_key().alias("key"))
    return packed.join(found, "key", "left").select("_row", "_gone")


def edited(text: Column, gone: Column) -> Column:
    """The text without its deleted lines."""

    def rest(every: Column) -> Column:
        worded = F.filter(F.transform(every, lambda s, i: F.when(s.rlike("[^ \t-\r]"), i)), lambda i: i.isNotNull())
        return let(worded, lambda w: let(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.transform(gone, lambda g: F.get(w, g))), lambda kept: F.when(F.size(gone) == F.size(w), F.lit("")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(every, i)), "\n"))))

    return F.when(gone.isNull(), text).otherwise(let(F.split(text, "\n"), rest))


def dedup_report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row: doc_id, the edited text, and how many lines with a word there were and were deleted."""
    m = mark_lines(docs, min_words)
    n = F.regexp_count(whole(F.col("_row.text")), F.lit(r"(?m)^[^\n]*[^ \t-\r][^\n]*"))
    return m.select(F.col("_row.doc_id").alias("doc_id"), edited(F.col("_row.text"), F.col("_gone")).alias("text"), n.cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_deleted"))


def dedup_documents(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows with edited texts; rows that lost their whole text are gone, as it stands in an earlier row."""
    m = mark_lines(docs, min_words).withColumn("_text", edited(F.col("_row.text"), F.col("_gone")))
    own = [F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns]
    return m.where(F.col("_gone").isNull() | (F.col("_text") != "")).select(*own)
