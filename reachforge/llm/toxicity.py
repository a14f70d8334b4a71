"""Toxicity by cumulative-link ordinal regression on sparse word features.

P(grade > k) = logistic(w.x - t_k) with ordered thresholds t_0 < t_1 < ... and one weight vector for all of them. Features are the
distinct words of a text, and its stems with the number of distinct words that begin with them, as hashes; a word with many endings is
rare by each of them, its stem is not. The model keeps the FEATURES that tell toxic from other labelled documents best, chosen by turns
for each language and for all documents together, so that a language with few documents gets its own. It is fitted on a bounded sample
of labelled documents (SAMPLE, those with the smallest id hashes) and scores every document whole.

Labels are 0 or 1, so grades of toxic documents come from how many distinct words typical of toxic documents, or with typical stems,
they hold: grade 1, 2 (two or more) or 3 (five or more).

Defined results: a null or empty text has no words and gets the severity of that; null labels and labels without a document are left
out of the fit; without labels of both kinds no document is toxic and severity is 0; repeated rows each get their result; no rows
give none; other columns are ignored but `lang`, by which features are chosen where there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .decontaminate import PLAIN
from .ngram_join import Grams, texts_of

SAMPLE = 20_000
FEATURES = 1024
GRADES = (1, 2, 5)
#: Bytes of a stem, and how many distinct words of a text begin with it. A feature is a hash whose last 4 bits are 0 for a word, else 1 + 4 * place in STEMS + place in TIMES.
STEMS = (4, 6, 8)
TIMES = (1, 2, 3, 5)
CODE = 15


class Words(Grams):
    """Features of words without regard to case and ASCII punctuation."""

    def __init__(self):
        super().__init__(1, PLAIN)

    def found(self, texts: list[str], keep=None):
        """(features, text numbers), each pair once. keep: of hashes without their code, which to go on with."""
        import numpy as np

        hashes, owner, stems = self.begun([t.lower() for t in texts])
        out = []
        for k, (part, rows) in enumerate([(hashes, slice(None)), *stems]):
            base = part & ~np.uint64(CODE)
            at, word = owner[rows], hashes[rows]
            if keep is not None:
                near = keep(base)
                base, at, word = base[near], at[near], word[near]
            order = np.lexsort((word, base, at))
            base, at, word = base[order], at[order], word[order]
            new = np.ones(len(base), bool)
            new[1:] = (base[1:] != base[:-1]) | (at[1:] != at[:-1])
            if not k:
                out.append((base[new], at[new]))
                continue
            first = np.flatnonzero(new)
            once = new.copy()
            once[1:] |= word[1:] != word[:-1]
            times = np.add.reduceat(once.astype(np.int64), first) if len(first) else first
            for i, least in enumerate(TIMES):
                ok = first[times >= least]
                out.append((base[ok] | np.uint64(1 + (k - 1) * len(TIMES) + i), at[ok]))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def begun(self, texts: list[str]):
        """Hashes and text numbers of all words; for each of STEMS the hashes of beginnings, and which words are that long."""
        import numpy as np

        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        joined = np.frombuffer((b"\n".join(raw) + b"\n").translate(self.table), np.uint8)
        self._grow(len(joined) + 1)
        space = (joined == 32) | ((joined >= 9) & (joined <= 13))
        start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * self.powers[: len(joined)])])
            cut_at = lambda a, b: self.mixed((sums[b] - sums[a]) * self.inverse[a])
            rows = [np.flatnonzero(end - start >= n) for n in STEMS]
            stems = [(cut_at(start[r], start[r] + n), r) for n, r in zip(STEMS, rows, strict=True)]
            hashes = cut_at(start, end)
        return hashes, np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), start, side="right"), stems


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, lang, words) of the sample; words are its features."""
    chosen = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    picked = docs.select("doc_id", "text", lang.alias("lang")).join(F.broadcast(chosen), "doc_id")  # SAMPLE rows at most

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = Words()
        for batch in batches:
            toxic, langs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            at = 0
            for ids, texts in texts_of(batch):
                hashes, owner = words.found(texts)
                order = np.lexsort((hashes, owner))
                ends = np.searchsorted(owner[order], np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, hashes[order].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(toxic[at : at + len(ids)], pa.int32()), pa.array(langs[at : at + len(ids)], pa.string()), lists], ["doc_id", "toxic", "lang", "words"])
                at += len(ids)

    got = picked.select("doc_id", "text", F.col("toxic").cast("int"), "lang").mapInArrow(run, "doc_id long, toxic int, lang string, words array<long>")
    return got.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.struct("words", "lang")).alias("m")).select("doc_id", "toxic", "m.lang", "m.words")


def fit(rows: DataFrame, features: int = FEATURES, rounds: int = 400) -> dict:
    """rows (doc_id, toxic, lang, words): the sample. Words are counted where they are; the driver gets the chosen words, and which of them each document holds."""
    import numpy as np

    n, n1 = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if n1 in (0, n):
        return {"features": np.zeros(0, np.int64), "weights": np.zeros(0), "thresholds": np.full(len(GRADES), 50.0)}
    # by language, and by all together as `every`; a language without both kinds is only in the latter
    total = rows.groupBy("lang").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).where("lang IS NOT NULL AND n1 > 0 AND n0 > 0")
    of_lang = rows.select("lang", "toxic", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    of_all = of_lang.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n")).select(F.lit(True).alias("every"), F.lit("").alias("lang"), "word", "bad", "n", F.lit(n1).cast("long").alias("n1"), F.lit(n - n1).cast("long").alias("n0"))
    counts = of_lang.join(F.broadcast(total), "lang").select(F.lit(False).alias("every"), "lang", "word", "bad", "n", "n1", "n0").unionByName(of_all)  # total: a row a language
    rates = counts.select("every", "lang", "word", "bad", "n1", "n0", ((F.col("bad") + 0.5) / (F.col("n1") + 1)).alias("p1"), ((F.col("n") - F.col("bad") + 0.5) / (F.col("n0") + 1)).alias("p0"))
    gain = F.abs(F.col("p1") - F.col("p0")) / F.sqrt(F.col("p1") * (1 - F.col("p1")) / F.col("n1") + F.col("p0") * (1 - F.col("p0")) / F.col("n0"))
    known = rates.select("every", "lang", "word", gain.alias("gain"), (F.expr("p1 > 10 * p0") & (F.col("bad") >= 3)).alias("typical"))
    turn = F.row_number().over(Window.partitionBy("every", "lang").orderBy(F.col("gain").desc(), "word"))
    turns = known.withColumn("turn", turn).where(F.col("turn") <= features).groupBy("word").agg(F.min("turn").alias("turn"), F.max("gain").alias("gain"), F.max("typical").alias("typical"))
    best = sorted(turns.orderBy("turn", F.col("gain").desc(), "word").limit(features).select("word", "typical").collect())  # FEATURES rows at most
    vocabulary = np.array([r["word"] for r in best], np.int64)
    typical = np.array([r["typical"] for r in best], bool)
    held = rows.select("doc_id", "toxic", F.array_intersect("words", F.array(*[F.lit(v) for v in vocabulary.tolist()]).cast("array<bigint>")).alias("words")).toArrow().sort_by("doc_id")  # SAMPLE rows of FEATURES words at most
    toxic, words = held["toxic"].to_numpy().astype(int), held["words"].combine_chunks()
    x = np.zeros((n, len(vocabulary)), np.float32)
    x[np.repeat(np.arange(n), np.diff(words.offsets.to_numpy())), np.searchsorted(vocabulary, words.flatten().to_numpy())] = 1
    # a stem that stands for so many words counts as many; of words and stems of each length the most counts
    code, hits = (vocabulary & CODE) - 1, np.zeros(n)
    for k in range(-1, len(STEMS)):
        most = {}
        for j in np.flatnonzero(typical & (code // len(TIMES) == k)).tolist():
            most.setdefault(int(vocabulary[j]) >> 4, []).append((TIMES[code[j] % len(TIMES)] if k >= 0 else 1, j))
        hits = np.maximum(hits, sum((x[:, [j for _, j in held]] * [least for least, _ in held]).max(1) for held in most.values()) if most else 0)
    grade = toxic * sum((hits >= g).astype(int) if g > 1 else 1 for g in GRADES)
    return {"features": vocabulary} | ordinal(x, grade, len(GRADES), rounds)


def ordinal(x, grade, steps: int, rounds: int, ridge: float = 1e-3) -> dict:
    """Weights and ordered thresholds by gradient steps with momentum on the mean negative log likelihood. Thresholds are a start and positive distances, so they stay ordered."""
    import numpy as np

    n, m = x.shape
    above = np.stack([grade > k for k in range(steps)], 1)
    w, first, gaps = np.zeros(m), 2.0, np.zeros(max(0, steps - 1))
    params = np.concatenate([w, [first], gaps])
    mean, square = np.zeros_like(params), np.zeros_like(params)
    for r in range(1, rounds + 1):
        w, t = params[:m], params[m] + np.concatenate([[0.0], np.cumsum(np.exp(params[m + 1 :]))])
        p = 1 / (1 + np.exp(-np.clip((x @ w.astype(np.float32))[:, None] - t, -40, 40)))
        bounds = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        rows = np.arange(n)
        mass = np.maximum(bounds[rows, grade] - bounds[rows, grade + 1], 1e-12)
        slope = np.zeros((n, steps))  # of the log likelihood by each P(grade > k)'s own logit
        for k in range(steps):
            s = p[:, k] * (1 - p[:, k]) / mass
            slope[:, k] = np.where(grade == k + 1, s, 0) - np.where(grade == k, s, 0)
        by_t = -slope.sum(0) / n
        grad = np.concatenate([-(x.T @ slope.sum(1).astype(np.float32)) / n + ridge * w, [-by_t.sum()], [-by_t[k + 1 :].sum() * np.exp(g) for k, g in enumerate(params[m + 1 :])]])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        params = params - 0.1 * (mean / (1 - 0.9**r)) / (np.sqrt(square / (1 - 0.999**r)) + 1e-8)
    assert above.shape == (n, steps)
    return {"weights": params[:m], "thresholds": params[m] + np.concatenate([[0.0], np.cumsum(np.exp(params[m + 1 :]))])}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Per row: doc_id, severity (expected grade), p_toxic (of a grade above 0), grade (likeliest), toxic."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        words = Words()
        order = np.argsort(model["features"].view(np.uint64))
        features, weights, t = model["features"].view(np.uint64)[order], np.asarray(model["weights"], float)[order], np.asarray(model["thresholds"], float)
        four, mask = np.uint64(4), np.uint64((1 << 16) - 1)
        bits = np.zeros(1 << 16, bool)
        bits[(features >> four) & mask] = True
        for batch in batches:
            for ids, texts in texts_of(batch):
                total = np.zeros(len(texts))
                if len(features):
                    hashes, owner = words.found(texts, lambda base: np.flatnonzero(bits[(base >> four) & mask]))
                    at = np.minimum(np.searchsorted(features, hashes), len(features) - 1)
                    ok = features[at] == hashes
                    total = np.bincount(owner[ok], weights[at[ok]], len(texts))
                p = 1 / (1 + np.exp(-np.clip(total[:, None] - t, -40, 40)))
                mass = np.concatenate([np.ones((len(texts), 1)), p], 1) - np.concatenate([p, np.zeros((len(texts), 1))], 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(mass.argmax(1).astype(np.int32)), pa.array(p[:, 0] >= 0.5)], ["doc_id", "severity", "p_toxic", "grade", "toxic"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def severity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    return score(docs, fit(cut(sample(docs, labels, most))))
