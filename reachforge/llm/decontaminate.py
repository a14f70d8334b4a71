"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Words are lower-cased and taken between white space and ASCII punctuation. Rolling hashes of all windows of `seed` words of the
benchmark items are looked up in the texts, each distinct one of a text once. The words of an item that shared seeds cover bound
what tiling can mark, so only items that can be leaked are tiled: the longest match of unmarked words, of equally long ones the first
in the text and then in the item, is found by rolling hashes and marked again and again, until none of `seed` words is left. An item is leaked
when the marked words are at least `coverage` of it, in whatever order its passages stand. A tiling takes at most as many rounds as the item has
seeds side by side, each in time linear in both, so repetitive texts cost no more than others.

The benchmark is given to the executors in blocks of about BLOCK_CHARS characters, each one broadcast of bounded size. A block is a
job of its own: a row carries what was found along, and between blocks the rows are written to the shared folder, so a task holds one block
and runs one worker whatever the size of the benchmark, and a row's verdict is its own whatever the number of blocks. With one block
nothing is written. Items of equal text are one item with several ids. Texts are not shuffled.

Defined results: a null text is empty and clean; null items and items under `seed` words match nothing; items with equal texts are
all reported; repeated rows get the same verdict, and rows that share an id have their own; no rows give none; no benchmark rows make
every document clean; other columns pass through unchanged in `drop_leaks`.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import GROUP_CHARS
from .common import cut, parts, remove, shared_dir

SEED = 5
COVERAGE = 0.5
#: Characters of a block; its index takes about 6 bytes for each, and 16 to 64 for each word.
BLOCK_CHARS = 4_000_000
#: Places of seeds in items that are looked at together.
PLACES = 1_000_000
FACTOR = 0x9E3779B97F4A7C15
#: ASCII punctuation becomes space.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_hashes(texts: list[str]):
    """Hashes of all words, and where each text ends among them."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    flat, ends = [], []
    for t in texts:
        flat += t.lower().encode("utf-8", "replace").translate(PLAIN).split()
        ends.append(len(flat))
    return np.fromiter(map(xxh3_64_intdigest, flat), np.uint64, len(flat)), np.array(ends, np.int64)


def windows(hashes, size: int):
    """Karp-Rabin hashes of all windows of so many words."""
    import numpy as np

    if len(hashes) < size:
        return hashes[:0]
    n, out = len(hashes) - size + 1, np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for i in range(size):
        out = out * np.uint64(FACTOR) + hashes[i : i + n]
    return out ^ (out >> np.uint64(31))


class Rolling:
    """Window hashes of any length over one sequence, each length in one step, and which words are marked."""

    def __init__(self, words, powers, inverse):
        import numpy as np

        self.np, self.inverse, self.marked = np, inverse, np.zeros(len(words), np.int64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[: len(words)])])

    def free(self, size: int):
        """The places of the windows without marked words, and their hashes."""
        np = self.np
        if size >= len(self.sums):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        taken = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(taken[size:] == taken[:-size])
        return at, (self.sums[at + size] - self.sums[at]) * self.inverse[at]


def tiled(text, item, seed: int) -> int:
    """Words of the item that greedy string tiling marks, of word hashes."""
    import numpy as np

    longest = max(len(text), len(item)) + 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest, FACTOR, np.uint64)]))
        inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest, pow(FACTOR, -1, 1 << 64), np.uint64)]))
        x, y = Rolling(text, powers, inverse), Rolling(item, powers, inverse)

        def match(size: int):
            """The first window of so many unmarked words that both have, as its places in text and item."""
            at, own = x.free(size)
            there, other = y.free(size)
            hit = np.flatnonzero(np.isin(own, other))
            return (int(at[hit[0]]), int(there[np.flatnonzero(other == own[hit[0]])[0]])) if len(hit) else None

        total, most = 0, min(len(text), len(item))
        while most >= seed and (found := match(seed)):
            low, high = seed, most  # a match of `low` words is known
            if best := match(most):  # often the last length once more
                low, found = most, best
            while low < high:
                middle = (low + high + 1) // 2
                if best := match(middle):
                    low, found = middle, best
                else:
                    high = middle - 1
            i, j = found
            x.marked[i : i + low] = y.marked[j : j + low] = 1
            total, most = total + low, low
    return total


class Items:
    """Benchmark items by their seeds, as arrays."""

    def __init__(self, rows: list[tuple[int, str]], seed: int = SEED):
        import numpy as np

        self.seed, self.ids, words, seeds, items, places = seed, [], [], [], [], []
        equal: dict[str, list] = {}
        for item, text in rows:
            equal.setdefault(text or "", []).append(item)
        for text, ids in equal.items():
            own, _ = word_hashes([text])
            if len(own) < seed:
                continue
            seeds.append(windows(own, seed))
            items.append(np.full(len(seeds[-1]), len(self.ids), np.int32))
            places.append(np.arange(len(seeds[-1]), dtype=np.int32))
            words.append(own)
            self.ids.append(ids)
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.words, self.start = flat(words, np.uint64), np.cumsum(self.size) - self.size
        every = flat(seeds, np.uint64)
        order = np.argsort(every, kind="stable")
        self.item, self.place = flat(items, np.int32)[order], flat(places, np.int32)[order]
        self.seeds, self.first, self.times = np.unique(every[order], return_index=True, return_counts=True)
        # a table of the lowest bits, so that nearly all windows of a text need one look-up
        self.mask = np.uint64((1 << max(16, (len(self.seeds) * 16).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[self.seeds & self.mask] = True

    def leaks(self, texts: list[str], coverage: float = COVERAGE) -> list[list[tuple[int, float]]]:
        """Of each text: the leaked items, with how much of each is marked."""
        import numpy as np

        words, ends = word_hashes(texts)
        found = windows(words, self.seed)
        out: list[list] = [[] for _ in texts]
        hits = np.flatnonzero(self.bits[found & self.mask])
        if not len(hits) or not len(self.seeds):
            return out
        which = np.minimum(np.searchsorted(self.seeds, found[hits]), len(self.seeds) - 1)
        owner = np.searchsorted(ends, hits, side="right")
        ok = (self.seeds[which] == found[hits]) & (hits + self.seed <= ends[owner])
        hits, which, owner = hits[ok], which[ok], owner[ok]
        begins = np.searchsorted(owner, np.arange(len(texts) + 1))
        once = np.unique(owner * len(self.seeds) + which)  # a seed counts once in a text
        seed_of, text_of = once % len(self.seeds), once // len(self.seeds)
        for k, item in self._possible(text_of, seed_of, coverage):
            a, b = begins[k], begins[k + 1]
            start, n = int(self.start[item]), int(self.size[item])
            own = self.words[start : start + n]
            # what of the text the item's seeds cover; its parts are set apart by a word of no item
            of_item = np.isin(found[hits[a:b]], windows(own, self.seed))
            at = np.unique(hits[a:b][of_item][:, None] + np.arange(self.seed))
            gap = np.flatnonzero(np.diff(at) > 1) + 1
            text = np.insert(words[at], gap, np.arange(1, len(gap) + 1, dtype=np.uint64))
            covered = tiled(text, own, self.seed)
            if covered >= coverage * n:
                out[k] += [(i, covered / n) for i in self.ids[item]]  # all ids of the text
        return out

    def _possible(self, text_of, seed_of, coverage: float):
        """(text, item) where the words of the item that shared seeds cover reach the coverage."""
        import numpy as np

        times = self.times[seed_of]
        part = (np.cumsum(times) - times) // PLACES
        # cut between texts only
        cuts = np.flatnonzero((np.diff(part) > 0) | (np.diff(text_of) > 0)) + 1
        last_cut, bounds = 0, [0]
        for c in cuts.tolist():
            if text_of[c] != text_of[c - 1] and part[c] != part[last_cut]:
                bounds.append(c)
                last_cut = c
        for a, b in zip(bounds, [*bounds[1:], len(seed_of)], strict=True):
            pieces = -(-int(times[a:b].sum()) // PLACES)
            if pieces <= 1:
                yield from self._covered(text_of[a:b], self.first[seed_of[a:b]], times[a:b], coverage)
                continue
            # one text with very many places: the places of a seed are in the order of items, so they are taken by ranges of items
            limits = np.linspace(0, len(self.ids), pieces + 1).astype(np.int64)
            key = np.repeat(np.arange(len(self.seeds)), self.times) * len(self.ids) + self.item
            low = np.searchsorted(key, seed_of[a:b] * len(self.ids))
            for limit in limits[1:].tolist():
                high = np.searchsorted(key, seed_of[a:b] * len(self.ids) + limit)
                yield from self._covered(text_of[a:b], low, high - low, coverage)
                low = high

    def _covered(self, text_of, first, n, coverage: float):
        """(text, item) where shared seeds, given by where their places begin and how many there are, cover enough of the item."""
        import numpy as np

        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        text, item, place = np.repeat(text_of, n), self.item[at].astype(np.int64), self.place[at].astype(np.int64)
        order = np.lexsort((place, item, text))
        text, item, place = text[order], item[order], place[order]
        if not len(text):
            return
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1])
        step = np.full(len(text), self.seed)
        step[1:] = np.where(new[1:], self.seed, np.minimum(place[1:] - place[:-1], self.seed))
        begin = np.flatnonzero(new)
        bound = np.add.reduceat(step, begin)
        for f in begin[bound >= coverage * self.size[item[begin]]].tolist():
            yield int(text[f]), int(item[f])


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> tuple[int, DataFrame]:
    """The number of blocks, at least one, and the items by text (ids, text, block). A block is collected when its turn has come."""
    equal = benchmark.where("text IS NOT NULL").groupBy("text").agg(F.collect_list(F.struct("item_id")).alias("ids"))
    n = 1 + 2 * (equal.agg(F.sum(F.length("text"))).first()[0] or 0) // most
    return n, equal.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)))


def leaks_of(batch, column: int, items: Items, coverage: float) -> list[list[tuple[int, float]]]:
    """Of each row of an Arrow batch: the leaked items. Some texts at a time are Python strings."""
    return [x for part in parts(batch, column, GROUP_CHARS) for x in items.leaks([t or "" for t in part.column(column).to_pylist()], coverage)]


def through_blocks(docs: DataFrame, benchmark: DataFrame, scan, schema, seed: int, block_chars: int) -> DataFrame:
    """The rows after the scan of every block: scan gives the function of batches for a broadcast block. What the last block but one left is written for the last, and stays in the shared folder."""
    spark, base = docs.sparkSession, None
    n, items = blocks(benchmark, block_chars)
    if n > 1:
        items = cut(items)
        base = f"{shared_dir(spark)}/blocks-{uuid4().hex}"
    for b in range(n):
        rows = [(i[0], r["text"]) for r in items.where(F.col("block") == b).select("text", "ids").collect() for i in r["ids"]]
        sent = spark.sparkContext.broadcast(Items(rows, seed))
        docs = docs.mapInArrow(scan(sent), schema)
        if b < n - 1:
            docs.write.parquet(f"{base}/{b}")
            docs = spark.read.parquet(f"{base}/{b}")
            sent.unpersist()
            if b:
                remove(spark, f"{base}/{b - 1}")
    return docs


def leak_report(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, items (leaked item ids in order), max_coverage (of the leaked ones, else 0)."""
    schema = "doc_id long, text string, found array<struct<item:long,part:double>>"

    def scan(items):
        def run(batches):
            import pyarrow as pa

            kind = pa.list_(pa.struct([("item", pa.int64()), ("part", pa.float64())]))
            for batch in batches:
                new = [[{"item": i, "part": c} for i, c in x] for x in leaks_of(batch, 1, items.value, coverage)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a + b for a, b in zip(batch.column(2).to_pylist(), new, strict=True)], kind)], ["doc_id", "text", "found"])

        return run

    out = docs.select(F.col("doc_id").cast("long"), "text", F.expr("CAST(array() AS array<struct<item:long,part:double>>)").alias("found"))
    out = through_blocks(out, benchmark, scan, schema, seed, block_chars)
    items = F.array_sort(F.transform("found", lambda f: f["item"]))
    return out.select("doc_id", (F.size("found") > 0).alias("contaminated"), F.size("found").cast("long").alias("n_items"), items.alias("items"), F.coalesce(F.array_max(F.transform("found", lambda f: f["part"])), F.lit(0.0)).alias("max_coverage"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The clean rows, with all their columns."""
    place = docs.columns.index("text")

    def scan(items):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                yield batch.filter(pa.array([not x for x in leaks_of(batch, place, items.value, coverage)], pa.bool_()))

        return run

    return through_blocks(docs, benchmark, scan, docs.schema, seed, block_chars)
