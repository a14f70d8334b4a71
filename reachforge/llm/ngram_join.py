"""Jaccard self-join of word n-gram sets, size-aware, with its connected components.

Documents with equal sets, by a 128-bit hash, form one class; only classes are compared, and called by as many bytes of the hash as tell them apart. Similar sets share n-grams early in one global order, and how
many they must share grows with the length of what is looked at: the first n - least + c of a set of n have c in common with any
similar set's. So a pair of similar sets shares a signature:
  - small sets enumerate all their subsets of the fixed size SUBSET from those first n-grams;
  - large sets give the first n - least + 1 n-grams, whose inverted lists are scanned.
The border between small and large is the size beyond which subsets cost more than list entries with the pairs that scanning those
gives. The order puts n-grams of rare hash buckets first; the bucket counts of all documents are one table of fixed size.

Lists of up to HOT classes give their pairs; of these stay those that the n-grams seen in common leave a chance. Longer lists, salted
where they are very long, give only (list, set). Then every set is compared to the leader of each long list it is in, and to the
first of the sets it is paired with, and what links to a leader is one component. So a group of copies costs a comparison a copy
and not one a pair. Pairs and lists whose sets are all in one component are done; what is left is compared pair by pair. In a long list
that still holds several components, each set is compared to the likeliest ones of other components and a few more, then to all that
have a chance. Before any comparison of sets stands one of their parity bits: each n-gram flips one bit of its set, so two sets differ
in at least as many n-grams as bits, and no similar pair is lost; large sets have more bits, which fold to fewer for smaller partners.
Long lists are compared in blocks of bits in memory, the component of the leader against the rest, and the rest among itself; sets stream,
sorted by leader, past the one set of that leader. Links are compared on whole sets of 64-bit n-gram hashes.

Defined results: null or empty texts, or texts of white space, have an empty set and are linked with nothing; fewer words than n give
one n-gram of them all; rows without doc_id take part, but an id of a component is the smallest that is not null (null if none is);
repeated rows each get their result; no rows give none; only doc_id and text are read; very long texts are sets like others, and one
set is held in memory at a time with a batch of rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, cut, cut_few, tasks_for
from .components import components

#: Characters of texts that are cut into n-grams at a time: some 100 bytes of arrays each.
GROUP_CHARS = 500_000
#: N-grams of sets that are looked up in their leader's at a time.
COMPARED = 1_000_000
#: Sets of a block that are compared to all of the block at a time.
ROWS_AT_ONCE = 125
#: Buckets of the table of n-gram counts, a power of two, and the pieces in which a task hands its counts on.
BUCKETS = 1 << 17
PIECES = 64
#: Size of the subsets that small sets enumerate.
SUBSET = 2
#: What counting a pair of a scanned list costs, against shuffling an entry or a subset.
PAIR_COST = 1 / 16
#: Classes in a list that gives its pairs one by one.
HOT = 8
#: Parity bits of a set, in 64-bit words; and the size beyond which it has more of them.
BIT_WORDS, LARGE = 16, 1000
#: Words to which the bits of large sets are folded first; such a set has at least as many.
SOME_WORDS = 64
#: Excess entries of a bucket for each further salt.
SALTED = 20_000
#: Pairs and entries of long lists that a scanning worker holds.
HELD_PAIRS, HELD_ENTRIES = 50_000, 20_000
#: Sets compared to one leader in a task.
LED = 5_000
#: So few pairs, or names of sets, are broadcast to the table of classes (some 12 MB); of more, both are dealt by set.
FEW_PAIRS = 250_000
#: Sets of a block of a long list.
BLOCK_SETS = 4000
#: Bytes of a set's hash by which it is called from there on: the fewest that tell all classes apart.
ID_BYTES = (8, 10, 12, 16)
#: Bits of the filter that keeps sets nobody asked for from being shuffled, as 64-bit words.
FILTER_WORDS = 1 << 17

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BASE = 0x9E3779B97F4A7C15


class Grams:
    """Sets of n-gram hashes of many texts at a time, computed over their joined bytes."""

    def __init__(self, n: int, table: bytes = LOWER):
        import numpy as np

        self.n, self.np, self.table = n, np, table
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        np = self.np
        if len(self.powers) < size:
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, BASE, np.uint64)]))
                self.inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)]))

    @staticmethod
    def mixed(x):
        """Spreads all bits over all bits; one to one."""
        import numpy as np

        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))

    def words(self, texts: list[str]):
        """Hashes of all words, and the number of words up to the end of each text."""
        np = self.np
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = np.frombuffer((b"\n".join(raw) + b"\n").translate(self.table), np.uint8)
        self._grow(len(joined) + 1)
        space = (joined == 32) | ((joined >= 9) & (joined <= 13))
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * self.powers[: len(joined)])])
            hashes = self.mixed((sums[end] - sums[start]) * self.inverse[start])
        ends = np.cumsum([len(r) + 1 for r in raw])
        return hashes, np.searchsorted(start, ends)

    def sets(self, texts: list[str]) -> list:
        """The sorted distinct n-gram hashes of each text."""
        np = self.np
        hashes, ends = self.words(texts)
        n, total = self.n, len(hashes)
        with np.errstate(over="ignore"):
            grams = np.zeros(max(0, total - n + 1), np.uint64)
            for i in range(n):
                grams = grams * np.uint64(BASE) + hashes[i : i + len(grams)]
            grams = self.mixed(grams)
            out, start = [], 0
            for end in ends.tolist():
                size = end - start
                if size >= n:
                    out.append(np.unique(grams[start : end - n + 1]))
                elif size:
                    g = np.zeros(1, np.uint64)
                    for h in hashes[start:end]:
                        g = g * np.uint64(BASE) + h
                    out.append(self.mixed(g ^ np.uint64(size)))
                else:
                    out.append(np.zeros(0, np.uint64))
                start = end
        return out


def parity_bits(grams, words: int = BIT_WORDS):
    """So many 64-bit words: a bit is set where an odd number of n-grams falls on it. Halves that are laid over each other by exclusive or are the bits of half as many words."""
    import numpy as np

    places = (grams >> np.uint64(32)) % np.uint64(64 * words)
    return np.packbits((np.bincount(places.astype(np.int64), minlength=64 * words) & 1).astype(np.uint8)).view(np.int64)


def many_bits(grams) -> bytes | None:
    """Four to eight bits for each n-gram of a large set."""
    return parity_bits(grams, 1 << (4 * len(grams) // 64).bit_length()).tobytes() if len(grams) > LARGE else None


def differing(x, y):
    """Of each row of x and each of y, as 64-bit words: in how many bits they differ."""
    import numpy as np

    if len(x) * len(y) <= 10_000:
        return np.bitwise_count(x.view(np.uint64)[:, None] ^ y.view(np.uint64)[None, :]).sum(2, dtype=np.int64)
    one = lambda z: np.unpackbits(np.ascontiguousarray(z).view(np.uint8), axis=1).astype(np.float32)
    a, b = one(x), one(y)
    return a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * (a @ b.T)


def shared_at_most(na: int, nb: int, x: bytes, y: bytes) -> int:
    """Of two large sets, with their many bits."""
    import numpy as np

    p, q = (np.frombuffer(z, np.uint64).reshape(1, -1) for z in (x, y))
    words = min(p.shape[1], q.shape[1])
    return min(na, nb, (na + nb - int(np.bitwise_count(folded(p, words) ^ folded(q, words)).sum())) // 2)


def folded(x, words: int):
    import numpy as np

    return np.bitwise_xor.reduce(x.reshape(len(x), -1, words), axis=1)


def set_id(grams, size: int = 16) -> bytes | None:
    """The first bytes of a 128-bit hash."""
    from hashlib import blake2b

    return blake2b(grams.tobytes(), digest_size=16).digest()[:size] if len(grams) else None


class Similarity:
    """Intersection bounds for a Jaccard similarity of at least percent / 100."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, a: int, b: int) -> int:
        """The least intersection of similar sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def least(self, n: int) -> int:
        """The least intersection of a set of n with any similar set; also the least size of that."""
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def seen(self, n: int, need: int) -> int:
        """The part of a set's list entries that counts for a partner: midway between the fewest that a similar pair cannot miss and all of them. Fewer mean fewer pairs, more that the number in common tells more."""
        return (n - need + 2 + self.prefix(n)) // 2

    def subset_sizes(self, n: int, border: int | None = None) -> list[int]:
        """The sizes of the subsets that a set of n has in common with similar sets of at most its own size, and at most the border."""
        return sorted({min(SUBSET, self.least(m)) for m in range(self.least(n), min(n, border or n) + 1)})

    def subsets(self, n: int) -> int:
        return sum(comb(n - self.least(n) + c, c) for c in self.subset_sizes(n))

    def costs(self, n: int, length: float) -> tuple[float, float]:
        """Of a set of n: of its subsets, and of its list entries with the pairs that lists of this mean length give."""
        return self.subsets(n), (1 + PAIR_COST * min(length, HOT)) * self.prefix(n)

    def border(self, length: float) -> int:
        """The largest set, counted up from 1, for which subsets are no dearer than list entries."""
        b = 0
        while (c := self.costs(b + 1, length))[0] <= c[1]:
            b += 1
        return b

    def signatures(self, grams, order, border: int):
        """(signatures, places) of a set: places in the global order, -1 for subsets; order: the rank of each gram's bucket."""
        import numpy as np

        n, out, kinds = len(grams), [], []
        longest = min(n, n - self.least(n) + SUBSET)
        first = grams[np.lexsort((grams, order))[:longest]]
        if self.least(n) <= border:  # it may meet a set of at most the border
            for c in self.subset_sizes(n, border):
                subset = np.fromiter((hash_all(x) for x in combinations(first[: n - self.least(n) + c].tolist(), c)), np.uint64)
                out.append(subset)
                kinds += [-1] * len(subset)
        if n > border:
            out.append(first[: self.prefix(n)])
            kinds += range(len(out[-1]))
        return np.concatenate(out), np.array(kinds, np.int32)


def hash_all(grams: tuple[int, ...]) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(b"".join(g.to_bytes(8, "little") for g in grams))


def texts_of(batch):
    """The rows of an Arrow batch of (doc_id, text), some texts at a time; only these are Python strings."""
    import pyarrow.compute as pc

    start = size = 0
    for i, length in enumerate(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()):
        size += length
        if size >= GROUP_CHARS or i == batch.num_rows - 1:
            part = batch.slice(start, i + 1 - start)
            yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            start, size = i + 1, 0


def content() -> list[Column]:
    """128 bits of the text, as a and b; null is not the empty text."""
    return [F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")]


class Join:
    """The stages of the join; each method is one scan or one shuffle."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        self.docs, self.n, self.sim = docs.select(F.col("doc_id").cast("long"), "text"), n, Similarity(percent)
        first = cut(self._members())
        whole = first.where("sid IS NOT NULL").groupBy("sid")
        classes = cut(whole.agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("some").alias("some"), F.first("wide").alias("wide"), F.min("doc_id").alias("least"), F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "a", "b")).alias("first")))
        self.id_bytes = self._short(classes)
        short = F.substring("sid", 1, self.id_bytes)
        self.members = first.where("piece IS NULL").select("doc_id", "n", short.alias("sid"), "a", "b")
        self.classes = classes.withColumn("sid", short)
        self._order(first.where("piece IS NOT NULL").select("piece", "counts"))

    @staticmethod
    def _short(classes: DataFrame) -> int:
        every = classes.count()
        return next(b for b in ID_BYTES if b == ID_BYTES[-1] or classes.select(F.substring("sid", 1, b).alias("s")).distinct().count() == every)

    def _order(self, pieces: DataFrame) -> None:
        """pieces (piece, counts): parts of tables, which are summed up in two steps; PIECES sums reach the driver."""
        import numpy as np

        def summed(table):
            import pyarrow as pa

            total = sum(np.frombuffer(c.as_py(), np.int64) for c in table["counts"])
            return pa.table({"piece": table["piece"][:1].cast(pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

        table = np.zeros((PIECES, BUCKETS // PIECES), np.int64)
        some = pieces.groupBy("piece", F.pmod(F.xxhash64("counts"), F.lit(256))).applyInArrow(summed, "piece int, counts binary")
        for piece, counts in some.groupBy("piece").applyInArrow(summed, "piece int, counts binary").collect():
            table[piece] = np.frombuffer(counts, np.int64)
        table = table.reshape(-1)
        self.salts = 1 + np.maximum(0, table - 2 * int(np.median(table))) // SALTED
        self.table = table.astype(np.float32)
        # the mean list of an n-gram, beyond what else is in its bucket
        self.length = max(0.0, float((table.astype(float) ** 2).sum() / max(1, table.sum())) - float(table.mean()))
        self.border = self.sim.border(self.length)

    def _members(self) -> DataFrame:
        """(doc_id, size, set id, content hashes a and b, parity bits) of all rows, and from each task the counts of its buckets (piece, counts)."""
        n = self.n

        def run(batches):
            import numpy as np
            import pyarrow as pa

            grams, counts = Grams(n), np.zeros(BUCKETS, np.int64)
            names = ["doc_id", "n", "sid", "a", "b", "bits", "some", "wide", "piece", "counts"]
            for batch in batches:
                at = 0
                for ids, texts in texts_of(batch):
                    sets = grams.sets(texts)
                    counts += np.bincount((np.concatenate(sets) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS)
                    bits = pa.ListArray.from_arrays(pa.array(range(0, BIT_WORDS * (len(sets) + 1), BIT_WORDS), pa.int32()), pa.array(np.concatenate([parity_bits(s) for s in sets])))
                    wide = [many_bits(s) for s in sets]
                    some = [w and folded(np.frombuffer(w, np.int64).reshape(1, -1), SOME_WORDS).tobytes() for w in wide]
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.binary()), *[batch.column(k).slice(at, len(ids)) for k in (2, 3)], bits, *[pa.array(b, pa.binary()) for b in (some, wide)], pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], names)
                    at += len(ids)
            if counts.any():
                none = [pa.nulls(PIECES, pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([*none, pa.nulls(PIECES, pa.binary()), *none, pa.nulls(PIECES, pa.list_(pa.int64())), *[pa.nulls(PIECES, pa.binary())] * 2, pa.array(range(PIECES), pa.int32()), pa.array([c.tobytes() for c in counts.reshape(PIECES, -1)], pa.binary())], names)

        return self.docs.select("doc_id", "text", *content()).mapInArrow(run, "doc_id long, n long, sid binary, a long, b long, bits array<long>, some binary, wide binary, piece int, counts binary")

    def lists(self) -> DataFrame:
        """(sig, salt, sid, n, place): entries of inverted lists, those of equal sets in one task once."""
        n, sim, border, table, salts, size = self.n, self.sim, self.border, self.table, self.salts, self.id_bytes

        def run(batches):
            import numpy as np
            import pyarrow as pa

            grams, seen = Grams(n), set()
            for batch in batches:
                for _, texts in texts_of(batch):
                    sigs, salt, sids, sizes, kinds = [], [], [], [], []
                    for s in grams.sets(texts):
                        sid = set_id(s, size)
                        if sid is None or sid in seen:
                            continue
                        if len(seen) > 500_000:
                            seen.clear()
                        seen.add(sid)
                        sig, kind = sim.signatures(s, table[(s % np.uint64(BUCKETS)).astype(np.int64)], border)
                        own = np.where(kind < 0, 1, salts[(sig % np.uint64(BUCKETS)).astype(np.int64)])
                        sigs.append(sig)
                        # -1: an unsalted list
                        salt.append(np.where(own > 1, int.from_bytes(sid[:4], "little") % own, -1))
                        sids += [sid] * len(sig)
                        sizes += [len(s)] * len(sig)
                        kinds.append(kind)
                    if sids:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(salt).astype(np.int32)), pa.array(sids, pa.binary()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(kinds))], ["sig", "salt", "sid", "n", "place"])

        return self.docs.mapInArrow(run, "sig long, salt int, sid binary, n int, place int")

    def scanned(self) -> DataFrame:
        """Scans the sorted lists as streams. (a, b, na, nb, c): pairs of short lists with what they share there; (a, sig, n): entries of long lists, b null."""
        percent, sim = self.sim.percent, self.sim

        def run(batches):
            import pyarrow as pa

            names = ["a", "b", "na", "nb", "c", "sig"]
            pairs: dict = {}
            hot: list = []

            def packed(rows):
                types = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

            def flush(most_pairs=0, most_hot=0):
                if len(pairs) > most_pairs:
                    yield packed([(*k, c, None) for k, c in pairs.items()])
                    pairs.clear()
                if len(hot) > most_hot:
                    yield packed([(sid, None, n, None, None, sig) for sid, n, sig in hot])
                    hot.clear()

            key, run_of, long = None, {}, False

            def close():
                """Ends a list that stayed short."""
                if not long and len(run_of) > 1:
                    ms = sorted(run_of.items())
                    for i, (a, (na, pa_)) in enumerate(ms):
                        for b, (nb, pb) in ms[i + 1 :]:
                            if 100 * min(na, nb) < percent * max(na, nb):
                                continue
                            if pa_ >= 0:
                                need = sim.overlap(na, nb)
                                if pa_ >= sim.seen(na, need) or pb >= sim.seen(nb, need):
                                    continue
                            k = (a, b, na, nb)
                            pairs[k] = pairs.get(k, 0) + (1 if pa_ >= 0 else 1_000_000)

            for batch in batches:
                for sig, salt, sid, n, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (sig, salt, place < 0) != key:
                        close()
                        yield from flush(HELD_PAIRS, HELD_ENTRIES)
                        key, run_of, long = (sig, salt, place < 0), {}, salt >= 0
                    if long:
                        hot.append((sid, n, sig))
                        if len(hot) > HELD_ENTRIES:
                            yield from flush(HELD_PAIRS, HELD_ENTRIES)
                    elif sid not in run_of:
                        run_of[sid] = (n, place)
                        if len(run_of) > HOT:
                            hot += [(s, x, sig) for s, (x, _) in run_of.items()]
                            run_of, long = {}, True
            close()
            yield from flush()

        lists = self.lists()
        keyed = lists.repartition(self._tasks(), "sig", "salt").sortWithinPartitions("sig", "salt", F.col("place") < 0)
        return keyed.mapInArrow(run, "a binary, b binary, na int, nb int, c int, sig long")

    def _tasks(self) -> int:
        return int(self.docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(sid, grams) of the wanted set ids, from one more scan of the texts. A bit filter of fixed size over content hashes keeps most other texts from being cut into n-grams; joins drop the rest."""
        n, size, short = self.n, 64 * FILTER_WORDS, self.id_bytes
        words = wanted.join(self.classes, "sid").select(F.pmod("first.a", F.lit(size)).alias("p")).select(F.expr("CAST(p DIV 64 AS INT)").alias("w"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("m"))
        found = [(r[0], r[1]) for r in words.groupBy("w").agg(F.bit_or("m").alias("m")).collect()]  # FILTER_WORDS rows at most

        def run(batches):
            import numpy as np
            import pyarrow as pa

            grams, seen, asked = Grams(n), set(), np.zeros(FILTER_WORDS, np.uint64)
            for w, m in found:
                asked[w] = m & 0xFFFFFFFFFFFFFFFF
            for batch in batches:
                place = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((asked[place // 64] >> (place % 64).astype(np.uint64)) & np.uint64(1) == 1))
                if not batch.num_rows:
                    continue
                for _, texts in texts_of(batch):
                    keep = []
                    for s in grams.sets(texts):
                        sid = set_id(s, short)
                        if sid is None or sid in seen:
                            continue
                        if len(seen) > 200_000:
                            seen.clear()
                        seen.add(sid)
                        keep.append((sid, s.view(np.int64)))
                    if keep:
                        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keep], pa.binary()), pa.array([k[1] for k in keep], pa.list_(pa.int64()))], ["sid", "grams"])

        return self.docs.select("doc_id", "text", F.pmod(F.xxhash64("text"), F.lit(size)).alias("place")).mapInArrow(run, "sid binary, grams array<long>").groupBy("sid").agg(F.first("grams").alias("grams"))

    def labels(self) -> DataFrame:
        """(v, c): the component of each set with a link, as its least set id."""
        sim, scanned = self.sim, cut(self.scanned())
        need = F.ceil(F.lit(sim.percent) * (F.col("na") + F.col("nb")) / (100 + sim.percent))
        # what of a set does not count in lists, as sim.seen has it
        rest = lambda n: F.col(n) - F.floor((2 * F.col(n) - need + 3 - F.ceil(F.lit(sim.percent) * F.col(n) / 100)) / 2)
        pairs = scanned.where("b IS NOT NULL").groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
        pairs = cut_few(self.near(pairs.where(F.col("c") + F.greatest(rest("na"), rest("nb")) >= need).select("a", "b")))
        hot = cut_few(scanned.where("b IS NULL").select("sig", F.col("a").alias("sid"), F.col("na").alias("n")).distinct())
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("w")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("w")))
        first = both.groupBy("u").agg(F.min("w").alias("w")).where("w < u").select(F.col("w").alias("a"), F.col("u").alias("b"))
        done = cut_few(self.compared(cut_few(first.unionByName(self.near(self.led(hot))).distinct())))
        label = self.joined(done)
        hot = cut_few(self.unsettled(hot, label))
        asked = cut(hot.select("sid").distinct())
        asked = F.broadcast(asked) if asked.count() <= FEW_PAIRS else asked
        self.hot_classes = cut_few(asked.join(self.classes.select("sid", "bits", "some"), "sid"))
        new, rest = self.apart(pairs, label), True
        for partners in (8, None):
            crossed = cut_few(self.crossed(hot, partners))
            left = crossed.where("a IS NULL").select("sig").distinct()
            rest = not left.isEmpty()
            new = cut_few(new.unionByName(self.near(crossed.where("a IS NOT NULL").select("a", "b").distinct())).distinct().join(done.select("a", "b"), ["a", "b"], "left_anti"))
            if not new.isEmpty():
                found = cut_few(self.compared(new))
                label, done = self.joined(found, label), done.unionByName(found)
            if not rest:
                break
            hot, new = cut_few(self.unsettled(hot.select("sig", "sid", "n").join(left, "sig", "left_semi"), label)), new.limit(0)
        return label

    @staticmethod
    def joined(compared: DataFrame, label: DataFrame | None = None) -> DataFrame:
        """The components after these comparisons."""
        edges = compared.where("alike").select("a", "b")
        return cut_few(components(edges if label is None else edges.unionByName(label.select(F.col("v").alias("a"), F.col("c").alias("b")))))

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sizes and parity bits leave them a chance."""
        percent = self.sim.percent
        of = lambda c: self.classes.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
        differ = F.aggregate(F.zip_with("bitsa", "bitsb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        total = F.col("na") + F.col("nb")
        most = F.least(F.col("na"), F.col("nb"), F.floor((total - differ) / 2))
        pairs = cut(pairs)
        number = pairs.count()
        pairs = pairs.coalesce(tasks_for(number))
        small = F.broadcast if number <= FEW_PAIRS else lambda df: df
        left = small(small(pairs).join(of("a"), "a")).join(of("b"), "b").where(100 * most >= percent * (total - most)).select("a", "b", "na", "nb")

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                most = [shared_at_most(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)]
                keep = [100 * m >= percent * (na + nb - m) for m, na, nb in zip(most, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        large = self.classes.where("wide IS NOT NULL")
        wide = lambda c: large.select(F.col("sid").alias(c), F.col("wide").alias(f"wide{c}"))
        less = left.where(f"least(na, nb) <= {LARGE}").select("a", "b")
        both = small(small(left.where(f"least(na, nb) > {LARGE}")).join(wide("a"), "a").drop("bitsa", "bitsb")).join(wide("b"), "b")
        return less.unionByName(both.select("a", "b", "na", "nb", "widea", "wideb").mapInArrow(run, "a binary, b binary"))

    def crossed(self, hot: DataFrame, partners: int | None) -> DataFrame:
        """(a, b, sig): pairs of different components in long lists that parity bits leave a chance. Of each set the likeliest partner and the first few in its block, or all (None). A row without a pair names a list of which pairs were left out."""
        percent = self.sim.percent

        def pairs_of(rows: list):
            """rows (i, j, block, sid, n, c, bits, some) of one pair of blocks."""
            import numpy as np

            i, j = rows[0][:2]
            block, n = np.array([r[2] for r in rows]), np.array([r[4] for r in rows])
            label = np.unique(np.array([r[5] for r in rows], object), return_inverse=True)[1]
            bits = np.array([r[6] for r in rows], np.int64)
            large = np.flatnonzero([r[7] is not None for r in rows])
            some = np.frombuffer(b"".join(rows[k][7] for k in large), np.int64).reshape(len(large), SOME_WORDS)
            for start in range(0, len(rows), ROWS_AT_ONCE):
                own = np.arange(start, min(start + ROWS_AT_ONCE, len(rows)))
                total = n[own][:, None] + n[None, :]
                differ = differing(bits[own], bits)
                mine = np.flatnonzero(np.isin(large, own))
                if len(mine):
                    differ[np.ix_(large[mine] - start, large)] = differing(some[mine], some)
                most = np.minimum(np.minimum(n[own][:, None], n[None, :]), (total - differ) // 2)
                like = (100 * most >= percent * (total - most)) & (label[own][:, None] != label[None, :])
                if i != j:
                    like &= block[own][:, None] != block[None, :]
                if partners is not None:
                    chosen = like & (np.cumsum(like, axis=1) <= partners - 1)
                    at = np.where(like, most / total, -1).argmax(1)
                    chosen[np.arange(len(own)), at] = like[np.arange(len(own)), at]
                    if (chosen != like).any():
                        yield (None, None)  # of this list
                    like = chosen
                for a, b in zip(*(k.tolist() for k in np.nonzero(like)), strict=True):
                    yield tuple(sorted((rows[own[a]][3], rows[b][3])))

        def run(batches):
            import pyarrow as pa

            key, rows, found = None, [], set()

            def flush(most: int):
                if len(found) > most:
                    yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "sig"])
                    found.clear()

            def close():
                for a, b in pairs_of(rows) if rows else ():
                    found.add((a, b, key[0] if a is None else None))
                    yield from flush(HELD_PAIRS)

            for batch in batches:
                for sig, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if (sig, *row[:2]) != key:
                        yield from close()
                        key, rows = (sig, *row[:2]), []
                    rows.append(row)
            yield from close()
            yield from flush(0)

        known = hot
        leader = known.groupBy("sig").agg(F.min(F.struct("sid", "c")).alias("of")).select("sig", F.col("of.c").alias("main"))
        known = known.join(leader, "sig").withColumn("main", F.col("c") == F.col("main"))
        blocks = lambda own: F.greatest(F.lit(1), F.ceil(F.count_if(own) / BLOCK_SETS)).cast("int")
        count = known.groupBy("sig").agg(blocks(F.col("main")).alias("km"), blocks(~F.col("main")).alias("ko"), F.count(F.lit(1)).alias("all"))
        dealt = known.join(count, "sig").withColumn("block", F.pmod(F.xxhash64("sid"), F.when(F.col("main"), F.col("km")).otherwise(F.col("ko"))).cast("int"))
        to = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
        columns = ["sig", "i", "j", "block", "sid", "n", "c"]
        # a list of one block is one group; of others, blocks of the leader's component (from 0) against those of the rest (from -1 down), and those of the rest against each other
        one_block = F.col("all") <= BLOCK_SETS
        single = dealt.where(one_block).select("sig", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("block"), *columns[4:])
        dealt = dealt.where(~one_block)
        main = dealt.where("main").withColumn("o", to("ko")).select("sig", F.col("block").alias("i"), (-1 - F.col("o")).alias("j"), *columns[3:])
        rest = dealt.where("NOT main").withColumn("o", to("km")).select("sig", F.col("o").alias("i"), (-1 - F.col("block")).alias("j"), (-1 - F.col("block")).alias("block"), *columns[4:])
        among = dealt.where("NOT main").withColumn("o", to("ko")).select("sig", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), *columns[3:])
        # the bits are joined last, so that they are shuffled once
        rows = single.unionByName(main).unionByName(rest).unionByName(among).coalesce(tasks_for(hot.count())).join(self.hot_classes, "sid").select(*columns, "bits", "some")
        return rows.repartition(self._tasks(), "sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(run, "a binary, b binary, sig long")

    def led(self, hot: DataFrame) -> DataFrame:
        """(a, b): the leader of each long list, and the other sets of the list."""
        leader = hot.groupBy("sig").agg(F.min("sid").alias("a"))
        return hot.join(leader, "sig").where("sid != a").select("a", F.col("sid").alias("b")).distinct()

    @staticmethod
    def labelled(rows: DataFrame, label: DataFrame, of: str, name: str) -> DataFrame:
        """rows with the component of the set `of`."""
        v = label.select(F.col("v").alias(of), F.col("c").alias(name))
        return rows.join(v, of, "left").withColumn(name, F.coalesce(name, of))

    def apart(self, pairs: DataFrame, label: DataFrame) -> DataFrame:
        """The pairs of different components."""
        return self.labelled(self.labelled(pairs, label, "a", "ca"), label, "b", "cb").where("ca != cb").select("a", "b")

    def unsettled(self, hot: DataFrame, label: DataFrame) -> DataFrame:
        """The entries of the lists with several components, with their component c. Of lists of the same sets one is enough."""
        known = self.labelled(hot, label, "sid", "c")
        mark = [F.sum(F.xxhash64(F.lit(k), "sid").cast("decimal(38,0)")).alias(f"m{k}") for k in (0, 1)]
        several = known.groupBy("sig").agg(F.min("c").alias("low"), F.max("c").alias("high"), *mark).where("low != high")
        one = several.groupBy("m0", "m1").agg(F.min("sig").alias("sig")).select("sig")
        return known.join(one, "sig", "left_semi").select("sig", "sid", "n", "c")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """(a, b, alike) of distinct pairs. The sets of all b stream past the one of their a; an a with very many is in several tasks."""
        percent = self.sim.percent

        def run(batches):
            import numpy as np
            import pyarrow as pa

            key = own = None
            for batch in batches:
                a, salt, led = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
                grams = batch.column(4)
                offsets, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(np.uint64)
                alike = np.zeros(len(a), bool)
                i = 0
                while i < len(a):
                    if not led[i]:
                        key, own = (a[i], salt[i]), flat[offsets[i] : offsets[i + 1]].copy()
                        i += 1
                        continue
                    j = i
                    while j < len(a) and led[j] and (a[j], salt[j]) == key and (j == i or offsets[j + 1] - offsets[i] <= COMPARED):
                        j += 1
                    if i == j:
                        raise ValueError("a set without its leader")
                    part = flat[offsets[i] : offsets[j]]
                    hit = own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part
                    shared = np.diff(np.concatenate([[0], np.cumsum(hit)])[offsets[i : j + 1] - offsets[i]])
                    alike[i:j] = 100 * shared >= percent * (len(own) + np.diff(offsets[i : j + 1]) - shared)
                    i = j
                keep = pa.array(led, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(3).filter(keep), pa.array(alike).filter(keep)], ["a", "b", "alike"])

        many = pairs.groupBy("a").agg(F.floor(1 + F.count(F.lit(1)) / LED).cast("int").alias("k"))
        led = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("int").alias("salt"), F.lit(True).alias("led"), F.col("b").alias("sid"))
        asked = led.unionByName(led.select("a", "salt", F.lit(False).alias("led"), F.col("a").alias("sid")).distinct())
        rows = asked.join(self.sets(asked.select("sid").distinct()), "sid").select("a", "salt", "led", "sid", "grams")
        return rows.repartition(self._tasks(), "a", "salt").sortWithinPartitions("a", "salt", "led").mapInArrow(run, "a binary, b binary, alike boolean")

    def report(self) -> DataFrame:
        """Per row: doc_id, n_shingles, component_id."""
        joined = self.labels()
        linked = joined.join(self.classes, F.col("v") == F.col("sid")).select("sid", "c", "least")
        smallest = linked.groupBy("c").agg(F.min("least").alias("component_id"))
        of_class = linked.join(smallest, "c").select("sid", "component_id")
        ids = self.classes.join(of_class, "sid", "left").select("sid", F.coalesce("component_id", "least").alias("component_id"))
        size = F.col("n").alias("n_shingles")
        full = self.members.where("sid IS NOT NULL").join(ids, "sid").select("doc_id", size, "component_id")
        return full.unionByName(self.members.where("sid IS NULL").select("doc_id", size, F.col("doc_id").alias("component_id")))

    def chosen(self) -> DataFrame:
        """(id, a, b): of each component the row with the smallest id, then content; rows without shingles are their own."""
        label = self.labels().select(F.col("v").alias("sid"), "c")
        of = self.classes.join(label, "sid", "left").groupBy("c", F.when(F.col("c").isNull(), F.col("sid")).alias("own")).agg(F.min("first").alias("first")).select("first.*")
        return of.unionByName(self.members.where("sid IS NULL").select(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "a", "b").distinct())


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    return Join(docs, n, percent).report()


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, all columns: that with the smallest id, of equal ids or without any the one with the least content hashes; so rows without doc_id stay only if nothing with an id is like them, and different texts of one id are apart. Of rows that repeat id and text one stays."""
    stay = Join(docs, n, percent).chosen().select(F.col("id").alias("_id"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), *[c.alias(f"_{k}") for c, k in zip(content(), "ab", strict=True)])
    found = packed.join(stay, ["_id", "_a", "_b"], "left_semi")
    one = found.withColumn("_k", F.row_number().over(Window.partitionBy("_id", "_a", "_b").orderBy(F.lit(1)))).where("_k = 1")
    return one.select("_row.*")
