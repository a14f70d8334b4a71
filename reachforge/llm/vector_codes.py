"""Compression of vectors to codes: product quantisation by integer k-means, with a kd-tree search for the nearest entry.

A component x becomes the integer floor(4096 x), and a vector is cut into equal consecutive parts. Each part has a codebook, whose
first entries are the parts of the vectors with the smallest ids. In each round the driver builds a kd-tree over every codebook (a few
entries each, so their size is bounded) and broadcasts them; tasks search them for whole batches at once and add up the parts of each
entry; the integer sums meet in one aggregation, of which a fixed number of rows reaches the driver.

The search is branch and bound: from a node the side of a part is searched first, then the other side of all parts whose distance
to it is at most the best distance so far. Where the two are equal the side is still visited, as an entry with a lower index may lie there.

Defined results: rows whose vector is null or empty or holds null or non-finite components are dropped, as are rows whose vector is
longer or shorter than that of the smallest id kept; a width that is no multiple of the number of parts is filled up with zeros; rows without an id
come last in order, and ties of ids are ordered by their vectors; with fewer vectors than entries there are as many entries; repeated rows
each get their code; components beyond 2^27 are searched in exact integers of any size, and an error that no long holds is null; components of 2^62 and beyond count
as non-finite; no rows give none; other columns pass through encode unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Entries of a leaf of the kd-tree.
LEAF = 2
#: Integers below this fit with their squared differences, summed up, into 64 bits.
SMALL, TOO_LARGE = 1 << 27, float(1 << 62)


@dataclass(frozen=True)
class Codebooks:
    """entries[part][index]: a list of integers."""

    width: int
    entries: list[list[list[int]]]

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position."""
        return sha256(",".join(str(x) for part in self.entries for entry in part for x in entry).encode()).hexdigest()

    def search(self) -> tuple[int, list[Tree], bool]:
        """What tasks need: the width, a tree for each part, and whether the entries are too large for 64 bits."""
        return self.width, [Tree.over(part) for part in self.entries], any(abs(x) >= SMALL for part in self.entries for entry in part for x in entry)


@dataclass(frozen=True)
class Tree:
    """A node: entries (index, vector) in a leaf, else two sides that part at `axis`: low holds values up to `most`, high from `least` on."""

    leaf: list[tuple[int, list[int]]] | None = None
    axis: int = 0
    most: int = 0
    least: int = 0
    low: Tree | None = None
    high: Tree | None = None

    @staticmethod
    def over(entries: list[list[int]], which: list[int] | None = None) -> Tree:
        which = list(range(len(entries))) if which is None else which
        spread = [max(entries[i][d] for i in which) - min(entries[i][d] for i in which) for d in range(len(entries[0]))] if which else [0]
        axis = spread.index(max(spread))
        if len(which) <= LEAF or not spread[axis]:
            return Tree([(i, entries[i]) for i in which])
        ranked = sorted(which, key=lambda i: entries[i][axis])
        values = [entries[i][axis] for i in ranked]
        # equal values stay on one side, whichever parts them best
        at = min((k for k in range(1, len(values)) if values[k - 1] < values[k]), key=lambda k: abs(2 * k - len(values)))
        return Tree(None, axis, values[at - 1], values[at], Tree.over(entries, ranked[:at]), Tree.over(entries, ranked[at:]))

    def nearest(self, parts):
        """(index, squared distance) of each row's nearest entry; of equally near ones the lowest index."""
        import numpy as np

        best = np.full(len(parts), -1, np.int64)
        dist = np.zeros(len(parts), parts.dtype)
        self._search(parts, np.arange(len(parts)), best, dist)
        return best, dist

    def _search(self, parts, rows, best, dist) -> None:
        if not len(rows):
            return
        if self.leaf is not None:
            for index, entry in self.leaf:
                far = parts[rows] - entry
                far = (far * far).sum(axis=1)
                closer = (best[rows] < 0) | (far < dist[rows]) | ((far == dist[rows]) & (index < best[rows]))
                won = rows[closer.astype(bool)]
                best[won], dist[won] = index, far[closer.astype(bool)]
            return
        x = parts[rows, self.axis]
        left = (2 * x <= self.most + self.least).astype(bool)
        for side, other, own in ((self.low, self.high, left), (self.high, self.low, ~left)):
            mine = rows[own]
            side._search(parts, mine, best, dist)
            gap = self.least - parts[mine, self.axis] if other is self.high else parts[mine, self.axis] - self.most
            bound = np_positive(gap) ** 2
            other._search(parts, mine[(bound <= dist[mine]).astype(bool)], best, dist)


def np_positive(x):
    import numpy as np

    return np.maximum(x, 0)


def integers(rows, parts: int, exact: bool):
    """The integers of these rows of components, filled up to a multiple of parts: of 64 bits, or of any size if asked for or needed."""
    import numpy as np

    rows = np.floor(np.asarray(rows, np.float64) * SCALE)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % parts)))
    if not exact and (not len(rows) or np.abs(rows).max() < SMALL):
        return rows.astype(np.int64)
    return np.array([[int(v) for v in row] for row in rows.tolist()], object).reshape(rows.shape)


def components(column, width: int):
    """The components of an Arrow array of lists of this width."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def sound(vectors: DataFrame, column: str) -> DataFrame:
    """The rows whose vector has components, none of them null, non-finite or too large."""
    good = lambda x: F.coalesce((F.abs(x.cast("double")) * SCALE < TOO_LARGE) & ~F.isnan(x), F.lit(False))
    return vectors.where((F.size(column) > 0) & F.forall(column, good))


def train(vectors: DataFrame, id: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """The codebooks of all rows; None without rows."""
    kept = sound(vectors, column)
    width = (one := kept.orderBy(F.col(id).asc_nulls_last(), column).select(F.size(column)).first()) and one[0]
    if width is None:
        return None
    kept = kept.where(F.size(column) == width)
    seeds = integers([r[0] for r in kept.orderBy(F.col(id).asc_nulls_last(), column).select(column).limit(entries).collect()], parts, True)
    size = seeds.shape[1] // parts
    books = Codebooks(width, [[[int(x) for x in row[p * size : (p + 1) * size]] for row in seeds] for p in range(parts)])
    for _ in range(rounds):
        found = sums(kept, column, books).collect()  # parts x entries x positions at most
        new = [[list(e) for e in part] for part in books.entries]
        for p, e, at, total, count in found:
            new[p][e][at] = int(total) // count
        if new == books.entries:
            break  # further rounds would change nothing
        books = Codebooks(width, new)
    return books


def sums(kept: DataFrame, column: str, books: Codebooks) -> DataFrame:
    """(part, entry, at, total, count): the sum of each component over the parts assigned to an entry."""
    sent = kept.sparkSession.sparkContext.broadcast(books.search())
    count, entries = len(books.entries), len(books.entries[0])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        width, trees, exact = sent.value
        total = None
        for batch in batches:
            rows = integers(components(batch.column(0), width), count, exact)
            size = rows.shape[1] // count
            if total is None:
                total, number = np.zeros((count, entries, size), object), np.zeros((count, entries), np.int64)
            for p, tree in enumerate(trees):
                part = rows[:, p * size : (p + 1) * size]
                best, _ = tree.nearest(part)
                number[p] += np.bincount(best, minlength=entries)
                for e in np.unique(best).tolist():
                    total[p, e] += part[best == e].sum(axis=0)
        if total is not None:
            p, e, at = (x.ravel() for x in np.indices(total.shape))
            much = [str(int(x)) for x in total.ravel()]
            of = number[p, e]
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(at, pa.int32()), pa.array(much, pa.string()), pa.array(of, pa.int64())], ["part", "entry", "at", "total", "count"]).filter(pa.array(of > 0))

    each = kept.select(column).mapInArrow(run, "part int, entry int, at int, total string, count long")
    return each.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("count").alias("count"))


def encode(vectors: DataFrame, books: Codebooks, column: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The rows with a sound vector of the books' width, their columns (or those to keep) in `row`, with code (an index a part, two hex digits each) and error (squared distance)."""
    sent = vectors.sparkSession.sparkContext.broadcast(books.search())
    count = len(books.entries)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        width, trees, exact = sent.value
        digits = np.array([f"{k:02x}" for k in range(256)])
        for batch in batches:
            rows = integers(components(batch.column(0), width), count, exact)
            size = rows.shape[1] // count
            code, error = np.zeros((len(rows), count), "U2"), np.zeros(len(rows), object)
            for p, tree in enumerate(trees):
                best, dist = tree.nearest(rows[:, p * size : (p + 1) * size])
                code[:, p], error = digits[best], error + dist.astype(object)
            held = [int(x) if x < 1 << 63 else None for x in error]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(["".join(c) for c in code.tolist()], pa.string()), pa.array(held, pa.int64())], ["row", "code", "error"])

    packed = sound(vectors, column).where(F.size(column) == books.width).select(F.col(column).alias("_vector"), F.struct(*keep or vectors.columns).alias("row"))
    return packed.mapInArrow(run, StructType([packed.schema["row"], StructField("code", StringType()), StructField("error", LongType())]))


def decode(codes: DataFrame, books: Codebooks, code: str = "code") -> DataFrame:
    """All columns, and vector: what the code stands for."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(x / SCALE) for x in e]) for e in part]) for part in books.entries])
    index = F.transform(F.sequence(F.lit(0), F.lit(len(books.entries) - 1)), lambda p: F.get(F.get(entries, p), F.conv(F.substring(code, 2 * p + 1, F.lit(2)), 16, 10).cast("int")))
    return codes.withColumn("vector", F.slice(F.flatten(index), 1, books.width))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Trained on all rows and applied to them: vec_id, code, error, label_error (the error of all rows with an equal label), codebooks_sha256."""
    own = vectors.select("vec_id", "embedding", "label")
    books = train(own, parts=parts, entries=entries, rounds=rounds)
    if books is None:
        return own.where("false").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    done = cut(encode(own, books, keep=["vec_id", "label"]).select("row.vec_id", "row.label", "code", "error"))
    total = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum(F.col("error"))).alias("label_error")
    by_label = done.groupBy("label").agg(total)
    # a label of very many rows is on the left of a join that has one row a label on its right
    none, code = F.col("label").isNull(), F.coalesce(F.col("label").cast("string"), F.lit(""))
    key = lambda df: df.withColumn("_none", none).withColumn("_label", code)
    return key(done).join(key(by_label).drop("label"), ["_none", "_label"]).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
