"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A bounded, hash-ordered sample of labelled documents (``examples`` of each class at most, a documented parameter; all
smaller tables whole) is the example set. All of the examples' terms are kept. A term weighs (1 + log count) * idf *
(1 + lift * g), where idf comes from its documents in the whole corpus and g, from 0 to 1, is how far it goes with a
label in the sample: a supervised weighting, without which the many common words of long texts drown the few that
matter. A text's terms that no example holds weigh as the rarest do, and count in its length alone.

Examples are laid out in blocks of like ones. The index is sparse: a term has an entry for each block that holds it,
with the largest weight there and its postings. A text's terms give every block an upper bound of its cosines; blocks
are scored from the highest bound on, until the next bound is below the kth similarity, so the neighbours are the
exact ones. Terms that a quarter of the examples hold have whole rows instead of postings. Neighbours vote with their similarity to the power ``power``, classes weighted back to their share among
all training labels. A logistic curve, fitted on the examples with each left out of its own neighbours, turns the
votes' log odds into a calibrated score. The neighbours are the evidence.

Null and empty texts, and texts without a term of any example, have no neighbours and score the prior. Labels: a null
label or id is no label, an id labelled twice is toxic if any label says so. Without labels every score is 0. Equal
similarities go to the smaller id. Repeated rows are scored each; very long texts are scored whole, in steps of their
own; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, importable, map_steps, materialize

#: Bytes that stay in terms: ASCII letters and all of other scripts.
LETTERS = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(LETTERS).split()


def _times(row: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Product in the task's own thread; a linear algebra library would start threads in every task."""
    return np.einsum("i,ij->j", row, matrix)


class BlockMax:
    """Sparse block-max inverted index over example vectors of unit length."""

    def __init__(self, vectors: list[dict[int, float]], labels: list[int], ids: list[int], n_terms: int, block: int = 64):
        # Examples of like terms stand together, so that a block's maxima are few.
        order = sorted(range(len(vectors)), key=lambda i: (max(vectors[i], key=lambda t: (vectors[i][t], t), default=-1), ids[i]))
        self.block, self.n = block, len(order)
        self.blocks = -(-self.n // block)
        self.labels = np.array([labels[i] for i in order], np.int8)
        self.ids = np.array([ids[i] for i in order], np.int64)
        term = np.fromiter((t for i in order for t in vectors[i]), np.int64)
        place = np.repeat(np.arange(self.n), [len(vectors[i]) for i in order]).astype(np.int64)
        weight = np.fromiter((w for i in order for w in vectors[i].values()), np.float64)
        spread = np.bincount(term, minlength=n_terms) * 4 >= max(self.n, 1)
        #: Terms of a quarter of the examples and more have whole rows: their weights, and the largest of each block.
        self.row = np.where(spread, np.cumsum(spread) - 1, -1)
        self.dense = np.zeros((int(spread.sum()), self.blocks * block))
        own = spread[term]
        self.dense[self.row[term[own]], place[own]] = weight[own]
        self.dense_most = self.dense.reshape(len(self.dense), self.blocks, block).max(2) if self.blocks else np.zeros((len(self.dense), 0))
        term, place, weight = term[~own], place[~own], weight[~own]
        by = np.lexsort((place, term))
        term, self.place, self.weight = term[by], place[by].astype(np.int32), weight[by]
        key = term * max(self.blocks, 1) + self.place // block
        #: Entries of the others, one for each term and block: the block, the largest weight, and where the postings begin.
        self.begin = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else [], len(key)).astype(np.int64)
        self.most = np.maximum.reduceat(self.weight, self.begin[:-1]) if len(key) else np.zeros(0)
        self.at = (key[self.begin[:-1]] % max(self.blocks, 1)).astype(np.int32)
        self.of = np.searchsorted(term[self.begin[:-1]], np.arange(n_terms + 1))

    @staticmethod
    def _spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of the ranges, and the size of each range."""
        sizes = end - begin
        return np.arange(sizes.sum()) + np.repeat(begin - np.cumsum(sizes) + sizes, sizes), sizes

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions and similarities of the k most similar examples above zero, but not of id ``but``; ties go to the smaller id."""
        rows = self.row[terms]
        common, rows = weights[rows >= 0], rows[rows >= 0]
        entries, sizes = self._spread(self.of[terms], self.of[terms + 1])
        heavy, at = np.repeat(weights, sizes), self.at[entries]
        bounds = np.bincount(at, heavy * self.most[entries], self.blocks) + _times(common, self.dense_most[rows])
        order = np.argsort(-bounds, kind="stable")
        sims, places, kth, held, done, step = [], [], 0.0, 0, 0, 8
        while done < self.blocks:
            # Rounding stays within the margin.
            if bounds[order[done]] <= 0 or (held >= k and bounds[order[done]] < kth - 1e-9):
                break
            to = min(done + step, self.blocks)
            # Later steps take no block whose bound is too low.
            while held >= k and bounds[order[to - 1]] < kth - 1e-9:
                to -= 1
            taken = np.zeros(self.blocks, bool)
            taken[order[done:to]] = True
            own = taken[at]
            some = entries[own]
            posts, sizes = self._spread(self.begin[some], self.begin[some + 1])
            s = np.bincount(self.place[posts], np.repeat(heavy[own], sizes) * self.weight[posts], self.blocks * self.block)
            columns = (order[done:to, None] * self.block + np.arange(self.block)).ravel()
            s = s[columns]
            if len(rows):
                s = s + np.einsum("i,ijk->jk", common, self.dense.reshape(len(self.dense), self.blocks, self.block)[rows[:, None], order[done:to]]).ravel()
            hit = np.flatnonzero(s > 0 if held < k else s >= kth - 1e-9)
            where = columns[hit]
            if but is not None:
                other = self.ids[where] != but
                hit, where = hit[other], where[other]
            if len(hit):
                sims.append(s[hit])
                places.append(where)
                held += len(hit)
                if held >= k:
                    every = np.concatenate(sims)
                    kth = float(np.partition(every, len(every) - k)[len(every) - k])
            done, step = to, 2 * step
        if not held:
            return np.zeros(0, int), np.zeros(0)
        sims, places = np.concatenate(sims).round(9), np.concatenate(places)
        keep = np.lexsort((self.ids[places], -sims))[:k]
        return places[keep], sims[keep]


class Model:
    """Vocabulary, index and class weights; picklable, and bounded by the sample's texts."""

    def __init__(self, vocabulary: dict[bytes, int], weights: np.ndarray, rarest: float, index: BlockMax, prior: float, k: int, power: float):
        self.vocabulary, self.weights, self.rarest, self.index, self.prior, self.k, self.power = vocabulary, weights, rarest, index, prior, k, power
        share = float(index.labels.mean()) if index.n else 0.0
        self.votes = np.array([(1 - prior) / (1 - share) if share < 1 else 1.0, prior / share if share > 0 else 1.0])
        self.curve = (0.0, 1.0)

    @staticmethod
    def unit(counts: dict[int, int], weights: np.ndarray) -> dict[int, float]:
        """Weights of an example's terms over the vector's length."""
        raw = {t: (1 + math.log(n)) * float(weights[t]) for t, n in sorted(counts.items())}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items() if w} if norm else {}

    def odds(self, text: str | None, but: int | None = None) -> tuple[float | None, list[tuple[int, float, int]]]:
        """Log odds of the votes (none without a neighbour), and the evidence as (example's id, similarity, label)."""
        words = Counter(terms_of(text))
        terms = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        heavy = 1 + np.log(np.fromiter(words.values(), np.float64, len(words)))
        known = terms >= 0
        rest = float(np.square(heavy[~known] * self.rarest).sum())
        terms, heavy = terms[known], heavy[known]
        by = np.argsort(terms)
        terms = terms[by]
        heavy = heavy[by] * self.weights[terms]
        norm = math.sqrt(rest + float(np.square(heavy).sum()))
        terms, heavy = terms[heavy != 0], heavy[heavy != 0]
        if not len(terms):
            return None, []
        places, sims = self.index.nearest(terms, heavy / norm, self.k, but)
        if not len(places):
            return None, []
        labels = self.index.labels[places]
        votes = sims**self.power * self.votes[labels]
        own = 0.05 * votes.sum()
        share = (votes[labels == 1].sum() + own * self.prior) / (votes.sum() + own)
        share = min(max(share, 1e-9), 1 - 1e-9)
        return math.log(share / (1 - share)), list(zip(self.index.ids[places].tolist(), sims.tolist(), labels.tolist()))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """Score, and the evidence."""
        odds, evidence = self.odds(text)
        if odds is None:
            return self.prior, []
        a, b = self.curve
        return 1 / (1 + math.exp(-max(min(a + b * odds, 700.0), -700.0))), evidence


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Weighted fit of 1 / (1 + exp(-(a + b x))) with a small pull to a = 0, b = 1; b is not below 0."""
    a, b = 0.0, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -700, 700)))
        g = np.array([(w * (p - y)).sum() + 0.1 * a, (w * (p - y) * x).sum() + 0.1 * (b - 1)])
        v = w * p * (1 - p)
        move = np.linalg.solve(np.array([[v.sum() + 0.1, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.1]]), g)
        move *= min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
        a, b = a - move[0], max(b - move[1], 0.0)
        if np.abs(move).max() < 1e-9:
            break
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, examples: int = 1024, k: int = 25, lift: float = 8.0, power: float = 2.0) -> Model:
    """Fit on ``labels(doc_id, toxic)`` that have a text in ``docs(doc_id, text)``.

    The driver and each task hold the terms of at most ``2 * examples`` texts; idf counts all of ``docs``.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = known.hint("merge").join(texts.select("doc_id").hint("merge"), "doc_id", "left_semi")
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.0
    # The sample: at most 2 * examples rows come to the driver.
    chosen = {}
    for y in (0, 1):
        for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).collect():
            chosen[r["doc_id"]] = y
    if not chosen:
        return Model({}, np.zeros(0), 0.0, BlockMax([], [], [], 0), prior, k, power)
    spark = docs.sparkSession
    chosen_ids = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "doc_id long"))
    sample = materialize(texts.join(chosen_ids, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text")), "examples")

    def words(batch: pa.RecordBatch):
        counted = [Counter(terms_of(t)) for t in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "terms": [list(c) for c in counted], "n": [list(c.values()) for c in counted]}

    # One example at a time, as numbers: the driver holds each distinct term once.
    numbers, held = {}, {}
    for r in map_steps(sample, words, "doc_id long, terms array<binary>, n array<long>").toLocalIterator():
        own = np.fromiter((numbers.setdefault(bytes(w), len(numbers)) for w in r["terms"]), np.int32, len(r["terms"]))
        held[r["doc_id"]] = own, np.array(r["n"], np.int32)
    vocabulary = {w: i for i, w in enumerate(sorted(numbers))}
    order = np.fromiter((vocabulary[w] for w in numbers), np.int32, len(numbers))
    held = {i: (order[own], n) for i, (own, n) in held.items()}
    del numbers
    shared = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batch: pa.RecordBatch):
        # The last place is for terms of no example.
        seen, get = np.zeros(len(shared.value) + 1, np.int64), shared.value.get
        for text in batch.column("text").to_pylist():
            own = set(terms_of(text))
            seen[np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))] += 1
        found = np.flatnonzero(seen[:-1])
        yield {"term": [-1, *found.tolist()], "n": [batch.num_rows, *seen[found].tolist()]}

    # One number for each term of an example comes back.
    found = dict(map(tuple, map_steps(texts.select("text"), frequencies, "term int, n long").groupBy("term").agg(F.sum("n")).collect()))
    n_docs = found.get(-1, 0)
    idf = np.log((1 + n_docs) / (1 + np.array([found.get(i, 0) for i in range(len(vocabulary))])))
    ids = sorted(chosen)
    y = np.array([chosen[i] for i in ids])
    hits = np.zeros((2, len(vocabulary)))
    for i, own in zip(ids, y):
        if i in held:
            hits[own, held[i][0]] += 1
    weights = idf * (1 + lift * goes_with(hits, y))
    vectors = [Model.unit(dict(zip(*(x.tolist() for x in held[i]))) if i in held else {}, weights) for i in ids]
    model = Model(vocabulary, weights, math.log(1 + n_docs), BlockMax(vectors, y.tolist(), ids, len(vocabulary)), prior, k, power)
    del vectors, held
    if 0 < y.sum() < len(y):
        whole = spark.sparkContext.broadcast(model)

        def left_out(batch: pa.RecordBatch):
            odds = [whole.value.odds(t, but=i)[0] for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
            yield {"doc_id": batch.column("doc_id"), "odds": odds}

        # Adaptive reading would take the few examples in one task.
        rows = map_steps(sample.repartition(spark.sparkContext.defaultParallelism), left_out, "doc_id long, odds double").where("odds IS NOT NULL").collect()
        if rows:
            label = np.array([chosen[r["doc_id"]] for r in rows])
            model.curve = logistic(np.array([r["odds"] for r in rows]), label, model.votes[label])
        whole.destroy()
    shared.destroy()
    discard(sample)
    return model


def goes_with(hits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """From 0 to 1: how far a term, found in ``hits`` examples of each class, goes with a label.

    The chi-square of the term and the label, over what could be chance among as many terms, and not above 1.
    """
    pos, neg = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    a, b = hits[1], hits[0]
    n = pos + neg
    chi2 = n * (a * (neg - b) - b * (pos - a)) ** 2 / np.maximum((a + b) * (n - a - b) * pos * neg, 1e-9)
    chance = 2 * math.log(max(len(a), 2))
    return np.clip((chi2 - chance) / chance, 0, 1)


def score(docs: DataFrame, model: Model, evidence: int = 3) -> DataFrame:
    """``(doc_id, score, evidence)`` for each row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def step(batch: pa.RecordBatch):
        found = [shared.value.score(t) for t in batch.column("text").to_pylist()]
        yield {
            "doc_id": batch.column("doc_id"),
            "score": [s for s, _ in found],
            "evidence": [[{"doc_id": i, "similarity": s, "label": y} for i, s, y in e[:evidence]] for _, e in found],
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_steps(rows, step, "doc_id long, score double, evidence array<struct<doc_id:long,similarity:double,label:int>>")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    importable(docs.sparkSession)
    @F.pandas_udf("double")
    def scores(texts):
        return texts.map(lambda t: shared.value.score(t)[0])

    return docs.where(scores(F.col("text").cast("string")) < limit)
