"""Quality by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates.

A text is cut into words (runs of letters and digits, A-Z in lower case) and runs of marks; line ends are tokens too. Its
features are hashed single tokens, pairs, and runs of one to three token *shapes* (case, digits, length, the mark
itself), each in one of ``2 ** BITS`` buckets, with the value ``sqrt(count / all)``, so that every text has length one.

Training takes the rows of up to ``examples`` labelled ids, the first by a hash of the id, so a table of labels of any size
costs one scan of ids and no shuffle of texts. They are dealt into shards of about ``SHARD`` rows, and each shard runs the
updates one row after the other from the common state; per round the shards' changes are averaged by bucket, over the
shards that changed it. Besides the chosen ids only the state goes through the driver: two numbers for each of
``2 ** BITS`` buckets.

Null and empty texts have no features; their score is the bias, which starts at the labels' log-odds. Labels other than
0 and 1 and null ids teach nothing. Rows of an id that is labelled both ways teach the share of ones. Repeated rows are
rows like others. Ties cannot arise: a score depends on the text alone. A very long text is read in steps of ``STEP``
bytes. Without labels, or over an empty table, scores are 0.5 and the result is empty, respectively.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, importable, map_steps, materialize

#: Buckets (as a power of two), labelled rows of a shard, rounds, and bytes of one text that are held at a time.
BITS, SHARD, ROUNDS, STEP = 18, 2048, 4, 1 << 20
#: Step size, its smoothing, and the weights of absolute values and squares.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1e-4, 1e-3

_SPACE, _WORD, _MARK, _LINE = 0, 1, 2, 3
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[9, 11, 12, 13, 32]] = _SPACE
_KIND[10] = _LINE
for _low, _high in (("0", "9"), ("A", "Z"), ("a", "z")):
    _KIND[ord(_low) : ord(_high) + 1] = _WORD
_KIND[128:] = _WORD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CASE = np.zeros(256, bool)
_CASE[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Powers of an odd number and of its inverse, so that a run's hash does not depend on where it stands.
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.cumprod(np.full(STEP + 1, _BASE, np.uint64))
_INVERSES = np.cumprod(np.full(STEP + 1, pow(_BASE, -1, 1 << 64), np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and shape of each token of the bytes."""
    kind = _KIND[data]
    edge = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == _LINE)]))
    ends = np.append(edge[1:], len(data))
    real = kind[edge] != _SPACE
    starts, ends = edge[real], ends[real]
    kind = kind[starts].astype(np.uint64)

    def within(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[ends] - total[starts]

    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _INVERSES[: len(data)])])
    hashes = _mix((sums[ends] - sums[starts]) * _POWERS[starts] + kind)
    n, upper, digits = ends - starts, within(_CASE[data]), within(_DIGIT[data])
    case = np.where(upper == 0, 0, np.where(upper == n, 3, np.where(_CASE[data[starts]] & (upper == 1), 1, 2)))
    figures = np.where(digits == 0, 0, np.where(digits == n, 2, 1))
    size = np.minimum(np.log2(n + 1).astype(np.int64), 7)
    word = _mix(((case * 3 + figures) * 8 + size).astype(np.uint64) + np.uint64(1000))
    return hashes, np.where(kind == _WORD, word, hashes)


def _buckets(hashes: np.ndarray, shapes: np.ndarray, before: int) -> np.ndarray:
    """The buckets of all runs that end after the first ``before`` tokens, which only stand before the others."""

    def runs(of: np.ndarray, length: int, salt: int) -> np.ndarray:
        out = of[length - 1 :] + np.uint64(salt)
        for k in range(1, length):
            out = _mix(out * np.uint64(_BASE) + of[length - 1 - k : len(of) - k])
        return out[max(before - length + 1, 0) :]

    found = [runs(of, n, salt) for of, n, salt in ((hashes, 1, 1), (hashes, 2, 2), (shapes, 1, 3), (shapes, 2, 4), (shapes, 3, 5)) if len(of) >= n]
    return (_mix(np.concatenate(found)) >> np.uint64(64 - BITS)).astype(np.int32) if found else np.zeros(0, np.int32)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of at most ``STEP`` bytes; they end at white space where there is some."""
    at = 0
    while len(data) - at > STEP:
        spaces = np.flatnonzero(_KIND[data[at : at + STEP]] == _SPACE)
        end = at + (int(spaces[-1]) + 1 if len(spaces) else STEP)
        yield data[at:end]
        at = end
    yield data[at:]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of a text, and their values; the squares of the values sum to one."""
    hashes = shapes = np.zeros(0, np.uint64)
    buckets, counts, held = np.zeros(0, np.int32), np.zeros(0, np.int64), []
    for piece in _pieces(np.frombuffer(text, np.uint8)):
        if len(piece):
            new = _tokens(piece)
            before = len(hashes)
            hashes, shapes = np.concatenate([hashes, new[0]]), np.concatenate([shapes, new[1]])
            found, n = np.unique(_buckets(hashes, shapes, before), return_counts=True)
            hashes, shapes = hashes[-2:], shapes[-2:]
            held.append((found, n))
    if len(held) == 1:
        buckets, counts = held[0]
    elif held:
        total = np.zeros(1 << BITS, np.int64)
        for found, n in held:
            total[found] += n
        buckets = np.flatnonzero(total).astype(np.int32)
        counts = total[buckets]
    return buckets, np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


def _log_odds(p: float) -> float:
    return float(np.log(p / (1 - p)))


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader's weights for the sums ``z`` of (shifted) gradients and ``n`` of their squares."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _pass(rows: list[tuple[np.ndarray, np.ndarray, float]], z: np.ndarray, n: np.ndarray, bias: float) -> None:
    """One round over the rows, each an update of ``z`` and ``n`` in place."""
    for at, x, y in rows:
        w = weights(z[at], n[at])
        g = (1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35))) - y) * x
        grown = n[at] + g * g
        z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
        n[at] = grown


def train(rows: DataFrame, bias: float) -> np.ndarray:
    """Weights from stored ``rows(shard, row, at, x, y)`` by rounds of averaged shards."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for _ in range(ROUNDS):

        def learn(group):  # at most about SHARD rows
            own = group.sort_by("row").combine_chunks()
            new_z, new_n = z.copy(), n.copy()
            _pass([*zip(_lists(own["at"]), _lists(own["x"]), own["y"].to_pylist())], new_z, new_n, bias)
            at = np.flatnonzero(new_n != n)
            return pa.table({"at": at, "z": new_z[at] - z[at], "n": new_n[at] - n[at]})

        changes = rows.groupBy("shard").applyInArrow(learn, "at long, z double, n double").groupBy("at").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toPandas()
        z, n = z.copy(), n.copy()
        z[changes["at"]] += changes["z"]
        n[changes["at"]] += changes["n"]
    return weights(z, n)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    return np.split(flat, ends[:-1])


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [b or b"" for b in batch.column("text").cast(pa.binary()).to_pylist()]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", examples: int = 8192) -> tuple[np.ndarray, float]:
    """``(weights, bias)`` from ``docs(doc_id, text)`` and up to ``examples`` ids of ``labels(doc_id, <label>)`` with 0 or 1."""
    spark = docs.sparkSession
    importable(spark)
    known = labels.where(F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = known.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).collect()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")

    def step(batch: pa.RecordBatch):
        found = [features(t) for t in _texts(batch)]
        yield {"y": batch.column("y"), "at": [f[0] for f in found], "x": [f[1] for f in found]}

    given = texts.join(F.broadcast(spark.createDataFrame(chosen, "doc_id long, y double")), "doc_id")
    rows = map_steps(given.select("text", "y"), step, "y double, at array<int>, x array<float>")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "features")
    count, ones = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not count:
        discard(rows)
        return np.zeros(1 << BITS), 0.0
    bias = _log_odds((ones + 0.5) / (count + 1))
    shards = max(1, round(count / SHARD))
    found = train(rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))), bias), bias
    discard(rows)
    return found


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``(doc_id, score)`` for each row of ``docs(doc_id, text)``: the probability of label 1."""
    w, bias = model

    def step(batch: pa.RecordBatch):
        odds = [w[at] @ x.astype(np.float64) + bias for at, x in map(features, _texts(batch))]
        yield {"doc_id": batch.column("doc_id"), "score": 1 / (1 + np.exp(-np.clip(np.array(odds), -35, 35)))}

    return map_steps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), step, "doc_id long, score double")
