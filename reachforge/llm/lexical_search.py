"""Ranked lexical search over a clustered index.

Documents are put in a new order by recursive graph bisection: documents and their terms are a bipartite graph, and a set of documents is
halved so that the two halves need the fewest bits for the gaps of their terms' lists. Halving swaps pairs of documents by gain until
nothing is won. It is fitted on a bounded sample (SAMPLE distinct texts, SKETCH terms of each, FEATURES terms in all); what is kept
of each halving is, for each term, how much cheaper a document with it lies in one half. Every document, of the sample or not, then
goes down the tree of halves to a leaf, and within the leaf lies by how clear the last choice was.

That order is cut into shards of SHARD documents, each with inverted lists and the greatest impact of each term in it. An item's bound
for a shard is the sum of those. Shards are visited by bound: for each item first the FIRST best, then up to MORE, then all others; a
shard whose bound is under the score of the item's worst of k results so far is passed over, which is exact, as equal bounds are still
visited. Documents carry their doc_id through the new order, and equal scores are ordered by it. No step of a search shuffles postings; the index is
shuffled once, dealt by ranges of its order, so a cluster of very many documents or copies is in many tasks.

Items are searched in blocks of BLOCK characters, so what is broadcast is bounded however many there are. An index holds the terms of
a block's items; it can be built for any terms.

Defined results: a null or empty text, or one without a term, is no result of any item and does not count among the documents; an item
without terms has no results; rows that repeat item_id and text are one item; documents without doc_id come after all others of equal score;
repeated documents are results each; no documents or no items give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, cut, whole
from .ngram_join import Grams, texts_of

#: The bounded sample on which the order is fitted: texts, terms of a text, and terms in all.
SAMPLE, SKETCH, FEATURES = 4096, 512, 16384
#: Halvings from the root to a leaf at most, texts of the sample that are halved at least, and rounds of swaps.
DEPTH, HALVED, SWAPS = 7, 64, 20
#: Documents of a shard, and shards that each item visits first and next.
SHARD, FIRST, MORE = 1024, 4, 32
#: Characters of the items of one block.
BLOCK = 4_000_000
TOP = 10

#: Bytes of terms, with A-Z lower-cased; all others part terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(texts: list[str]):
    """Hashes of all terms, and the number of terms up to the end of each text."""
    return Grams(1, TERM_BYTES).words(texts)


def places(known, hashes):
    """Where each hash is among the sorted known ones, or -1."""
    import numpy as np

    if not len(known):
        return np.full(len(hashes), -1, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


# -- the order of documents


@dataclass(frozen=True)
class Halves:
    """The tree of halves: sorted hashes of terms, and for each node (children of i: 2i + 1, 2i + 2) what a term speaks for the second half."""

    features: object
    weights: object
    depth: int

    def leaves(self, doc, feature, count: int):
        """The leaf of each of count documents, and the last choice's value; (doc, feature): their distinct terms."""
        import numpy as np

        node, value = np.zeros(count, np.int64), np.zeros(count)
        for _ in range(self.depth):
            value = np.bincount(doc, self.weights[node[doc], feature], count)
            node = 2 * node + 1 + (value > 0)
        return node - (1 << self.depth) + 1, value


def bits(degree, size: int):
    """What the gaps of lists of these lengths cost among so many documents."""
    import numpy as np

    return degree * np.log2(max(size, 1) / (degree + 1.0))


def halve(doc, feature, members, count: int):
    """Halves the members. Returns the two halves and what each term speaks for the second; (doc, feature): terms of all documents."""
    import numpy as np

    side = np.full(1 + max(int(members.max()), int(doc.max()) if len(doc) else 0), -1)
    side[members[: len(members) // 2]], side[members[len(members) // 2 :]] = 0, 1
    own = side[doc] >= 0
    doc, feature = doc[own], feature[own]
    sizes = [len(members) // 2, len(members) - len(members) // 2]
    degrees = lambda: [np.bincount(feature[side[doc] == k], minlength=count).astype(float) for k in (0, 1)]
    for _ in range(SWAPS):
        d = degrees()
        # what is saved where a term's document goes from the first half to the second, and back
        saved = [bits(d[k], sizes[k]) + bits(d[1 - k], sizes[1 - k]) - bits(np.maximum(d[k] - 1, 0), sizes[k]) - bits(d[1 - k] + 1, sizes[1 - k]) for k in (0, 1)]
        gain = np.bincount(doc, np.where(side[doc] == 0, saved[0][feature], saved[1][feature]), len(side))
        movers = [ms[np.argsort(-gain[ms], kind="stable")] for ms in (members[side[members] == k] for k in (0, 1))]
        pairs = min(len(m) for m in movers)
        swap = int((gain[movers[0][:pairs]] + gain[movers[1][:pairs]] > 1e-9).sum())  # gains fall, so these come first
        if not swap:
            break
        side[movers[0][:swap]], side[movers[1][:swap]] = 1, 0
    d = degrees()
    speaks = bits(d[0] + 1, sizes[0]) - bits(d[0], sizes[0]) - bits(d[1] + 1, sizes[1]) + bits(d[1], sizes[1])
    return members[side[members] == 0], members[side[members] == 1], speaks


def bisect(sketches: list) -> Halves:
    """sketches: the term hashes of each text of the sample."""
    import numpy as np

    every, inverse, found = np.unique(np.concatenate([np.zeros(0, np.uint64), *sketches]), return_inverse=True, return_counts=True)
    often = np.flatnonzero(found > 1)
    often = np.sort(often[np.argsort(-found[often], kind="stable")[:FEATURES]])
    place = np.full(len(every), -1)
    place[often] = np.arange(len(often))
    doc, feature = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches]), place[inverse]
    doc, feature = doc[feature >= 0], feature[feature >= 0]
    depth = max(0, min(DEPTH, (len(sketches) // HALVED).bit_length()))
    weights = np.zeros(((1 << depth) - 1, max(1, len(often))), np.float32)
    level = {0: np.arange(len(sketches))}
    for _ in range(depth):
        below = {}
        for node, members in level.items():
            if len(members) >= HALVED:
                below[2 * node + 1], below[2 * node + 2], weights[node] = halve(doc, feature, members, weights.shape[1])
        level = below
    return Halves(every[often], weights, depth)


def fit_order(docs: DataFrame, sample: int = SAMPLE) -> Halves:
    """The tree of halves of a sample of the distinct texts: those with the least hashes, as many as expected."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sketches = []
            for _, texts in texts_of(pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["a", "text"])):
                hashes, ends = terms(texts)
                sketches += [np.unique(own)[:SKETCH].view(np.int64) for own in np.split(hashes, ends[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sketches, pa.list_(pa.int64()))], ["a", "b", "terms"])

    part = min(1.0, sample / max(1, docs.count()))
    keyed = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), "text")
    chosen = keyed.where(F.pmod("b", F.lit(1 << 30)) < int(part * (1 << 30)))
    rows = chosen.mapInArrow(run, "a long, b long, terms array<long>").groupBy("a", "b").agg(F.first("terms").alias("terms")).where(F.size("terms") > 0)
    found = rows.limit(2 * sample).collect()
    return bisect([np.array(r[2], np.int64).view(np.uint64) for r in sorted(found)])


def ordered(docs: DataFrame, order: Halves, vocabulary) -> DataFrame:
    """Per row: doc_id, n (its terms with repeats), leaf and value in the order, a salt, and the terms of the vocabulary (places) with their occurrences. One scan of the texts."""
    sent = docs.sparkSession.sparkContext.broadcast((order, vocabulary))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        order, known = sent.value
        width, row = max(1, len(known)), 0

        def lists(doc, values, count: int):
            offsets = np.searchsorted(doc, np.arange(count + 1))
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))

        for batch in batches:
            for ids, texts in texts_of(batch):
                hashes, ends = terms(texts)
                n = np.diff(np.concatenate([[0], ends]))
                doc = np.repeat(np.arange(len(texts)), n)
                every, inverse = np.unique(hashes, return_inverse=True)
                term, feature = places(known, every)[inverse], places(order.features, every)[inverse]
                own, tf = np.unique(doc[term >= 0] * width + term[term >= 0], return_counts=True)
                of = np.unique(doc[feature >= 0] * max(1, len(order.features)) + feature[feature >= 0])
                leaf, value = order.leaves(of // max(1, len(order.features)), of % max(1, len(order.features)), len(texts))
                salt = (np.arange(row, row + len(texts)) * 0x9E3779B1) & 0x7FFFFFFF
                row += len(texts)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(leaf, pa.int32()), pa.array(value, pa.float64()), pa.array(salt, pa.int32()), lists(own // width, own % width, len(texts)), lists(own // width, tf, len(texts))], ["doc_id", "n", "leaf", "value", "salt", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long"), whole("text").alias("text")).mapInArrow(run, "doc_id long, n long, leaf int, value double, salt int, terms array<int>, tf array<int>")


# -- the index


def shards(rows: DataFrame, documents: int, length: int, size: int = SHARD) -> DataFrame:
    """One row for each `size` documents in order: their doc_ids, the terms that they hold with the start of each one's list, places and impacts of the lists' documents, and each term's greatest impact."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["shard", "ids", "terms", "starts", "places", "impacts", "peaks"]
        held, number = [], TaskContext.get().partitionId() << 32

        def packed(parts):
            doc_ids = pa.concat_arrays([p.column(0) for p in parts])
            n = np.concatenate([p.column(1).to_numpy() for p in parts])
            counts = np.concatenate([np.diff(p.column(2).offsets.to_numpy()) for p in parts])
            term, tf = (np.concatenate([p.column(k).flatten().to_numpy() for p in parts]).astype(np.int64) for k in (2, 3))
            place = np.repeat(np.arange(len(n)), counts)
            m = 25 + (75 * n * documents) // length
            impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[place])
            by = np.argsort(term, kind="stable")
            own, starts = np.unique(term[by], return_index=True)
            peaks = np.maximum.reduceat(impact[by], starts) if len(own) else impact
            one = lambda x, kind: pa.array([x], pa.list_(kind))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), one(own, pa.int32()), one(starts, pa.int32()), one(place[by], pa.int32()), one(impact[by], pa.int32()), one(peaks, pa.int32())], names)

        have = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - have)
                batch = batch.slice(part.num_rows)
                held.append(part)
                have += part.num_rows
                if have == size:
                    yield packed(held)
                    held, have, number = [], 0, number + 1
        if held:
            yield packed(held)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["leaf", "value", "salt"]
    dealt = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).select("doc_id", "n", "terms", "tf")
    return dealt.mapInArrow(run, "shard long, ids array<long>, terms array<int>, starts array<int>, places array<int>, impacts array<int>, peaks array<int>")


# -- the search


class Items:
    """The items of a block: their distinct terms, and of each item the terms (places in the vocabulary) with how often it holds them."""

    def __init__(self, rows: list):
        import numpy as np

        hashes, ends = terms([r[1] or "" for r in rows])
        self.ids = [r[0] for r in rows]
        self.vocabulary, inverse = np.unique(hashes, return_inverse=True)
        item = np.repeat(np.arange(len(rows)), np.diff(np.concatenate([[0], ends])))
        own, self.often = np.unique(item * max(1, len(self.vocabulary)) + inverse, return_counts=True)
        self.item, self.term = np.divmod(own, max(1, len(self.vocabulary)))

    def weigh(self, documents: int, held: dict[int, int]) -> None:
        """held: for each place in the vocabulary the documents with that term."""
        import numpy as np

        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(self.vocabulary))], np.int64)
        self.weight = self.often * weight[self.term] if len(self.term) else self.often
        self.with_terms, self.starts = np.unique(self.item, return_index=True)

    def bounds(self, terms, peaks):
        """Of each item with terms: the greatest score that a document of a shard can have."""
        import numpy as np

        peak = np.zeros(len(self.vocabulary), np.int64)
        peak[terms] = peaks
        return np.add.reduceat(peak[self.term] * self.weight, self.starts) if len(self.starts) else np.zeros(0, np.int64)


class Best:
    """The k best (score, doc_id) of each item so far."""

    def __init__(self, count: int, k: int, least):
        import numpy as np

        self.k, self.least = k, np.maximum(least, 1)
        self.found: list[list] = [[] for _ in range(count)]

    def add(self, item: int, scores, ids, none) -> None:
        """ids: LAST_ID where none."""
        import numpy as np

        hits = np.flatnonzero(scores >= self.least[item])
        if len(hits) > self.k:
            hits = hits[scores[hits] >= np.partition(scores[hits], -self.k)[-self.k]]
            hits = hits[np.lexsort((ids[hits], -scores[hits]))[: self.k]]
        if len(hits):
            new = zip((-scores[hits]).tolist(), ids[hits].tolist(), none[hits].tolist(), strict=True)
            self.found[item] = sorted([*self.found[item], *new])[: self.k]
            if len(self.found[item]) == self.k:
                self.least[item] = max(self.least[item], -self.found[item][-1][0])


def visit(index: DataFrame, items: Items, least, k: int, only: dict | None = None, but: dict | None = None) -> DataFrame:
    """(item, doc_id, score): each task's k best of each item, from the shards whose bound reaches the item's least score; only: these shards' items, but: all except these."""
    sent = index.sparkSession.sparkContext.broadcast((items, least, only, but))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        items, least, only, but = sent.value
        best = Best(len(items.ids), k, least)
        last = np.append(items.starts[1:], len(items.term)) if len(items.starts) else items.starts
        for batch in batches:
            for i in range(batch.num_rows):
                shard, ids, own, starts, place, impact, peaks = (batch.column(c)[i] for c in range(7))
                shard = shard.as_py()
                if only is not None and shard not in only:
                    continue
                own, starts, place, impact, peaks = (x.values.to_numpy() for x in (own, starts, place, impact, peaks))
                bound = items.bounds(own, peaks)
                asked = np.flatnonzero(bound >= best.least[items.with_terms])
                if only is not None:
                    asked = asked[np.isin(items.with_terms[asked], only[shard])]
                elif shard in but:
                    asked = asked[~np.isin(items.with_terms[asked], but[shard])]
                none = ids.values.is_null().to_numpy(zero_copy_only=False)
                ids = ids.values.fill_null(LAST_ID).to_numpy()
                where = np.full(len(items.vocabulary), -1)
                where[own] = np.arange(len(own))
                ends = np.append(starts[1:], len(place))
                for a in asked.tolist():
                    scores = np.zeros(len(ids), np.int64)
                    for e in range(items.starts[a], last[a]):
                        t = where[items.term[e]]
                        if t >= 0:  # a list holds a document once
                            part = slice(starts[t], ends[t])
                            scores[place[part]] += items.weight[e] * impact[part].astype(np.int64)
                    best.add(int(items.with_terms[a]), scores, ids, none)
        rows = [(item, None if none else i, -s) for item, found in enumerate(best.found) for s, i, none in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def by_bound(index: DataFrame, items: Items, most: int) -> DataFrame:
    """(item, shard, rank): each item's shards of the greatest bounds."""
    sent = index.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        items = sent.value
        for batch in batches:
            for shard, own, peaks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                bound = items.bounds(own.values.to_numpy(), peaks.values.to_numpy())
                some = np.flatnonzero(bound > 0)
                yield pa.RecordBatch.from_arrays([pa.array(items.with_terms[some], pa.int32()), pa.array(np.full(len(some), shard), pa.int64()), pa.array(bound[some], pa.int64())], ["item", "shard", "bound"])

    bounds = index.select("shard", "terms", "peaks").mapInArrow(run, "item int, shard long, bound long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "shard"))
    return bounds.withColumn("rank", rank).where(F.col("rank") <= most).select("item", "shard", "rank")


def leading(found: DataFrame, k: int) -> DataFrame:
    """Each item's k best, with their rank."""
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search_block(docs: DataFrame, order: Halves, items: Items, k: int) -> DataFrame | None:
    """(item, rank, doc_id, score) of the items of one block."""
    import numpy as np

    rows = cut(ordered(docs, order, items.vocabulary))
    documents, length = rows.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    if not documents:
        return None
    index = cut(shards(rows, documents, length))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("places")))
    lists = index.where(F.size("terms") > 0).select(F.explode(F.arrays_zip(F.col("terms").alias("t"), F.zip_with(ends, "starts", lambda b, a: b - a).alias("d"))).alias("x"))
    items.weigh(documents, dict(lists.groupBy("x.t").agg(F.sum("x.d")).collect()))  # a row for each term of the block
    first = by_bound(index, items, MORE).collect()  # MORE rows for each item of the block
    found, least, seen = None, np.zeros(len(items.ids), np.int64), {}
    for low, high in ((0, FIRST), (FIRST, MORE)):
        only: dict[int, list[int]] = {}
        for item, shard, rank in first:
            if low < rank <= high:
                only.setdefault(shard, []).append(item)
                seen.setdefault(shard, []).append(item)
        new = visit(index, items, least, k, only=only)
        found = cut(leading(new if found is None else new.unionByName(found.drop("rank")), k))
        for item, score in found.where(F.col("rank") == k).select("item", "score").collect():
            least[item] = score
    return leading(visit(index, items, least, k, but=seen).unionByName(found.drop("rank")), k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Each item's k best documents: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    distinct = items.select("item_id", F.col("text")).where("text IS NOT NULL").distinct()
    blocks = 1 + (distinct.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK
    kind, order, out = items.schema["item_id"].dataType.simpleString(), None, None
    for b in range(blocks):
        block = Items(sorted(distinct.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect(), key=lambda r: (r[0] is None, r[0] or 0, r[1])))
        if not len(block.vocabulary):
            continue
        order = order or fit_order(docs)
        found = search_block(docs, order, block, k)
        if found is None:
            break
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        part = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
