"""Packing: non-negative least squares over shallow length combinations.

Documents become token ids, long ones are cut at the window, and the pieces are
packed into windows. Lengths are rounded up to a grid, so the histogram has a
fixed number of rows whatever the corpus. Combinations of one repeated length and
up to two further lengths that fill the window exactly are enumerated; a
non-negative least-squares fit gives how often each is used, the counts are
rounded down, and what remains is packed greedily. All of that is done on the
histogram. Pieces find their place by their rank within their length, which is
counted in salted groups, so a length that a third of all pieces share is still
dealt over many tasks.

Null texts are empty and give the end id alone; a null id is kept as null; rows
that repeat are packed each; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

import re
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_steps

#: Code points whose lower case, composition and class are the same in every Unicode version.
PLAIN = re.compile(r"[\t-\r -~¡-įıĲ-ɏ‐-‧]*")
#: How the tokenizer cuts lower-case text of ``PLAIN`` into parts that it encodes alone.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ɏ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ɏ0-9²³¹¼½¾]+")
#: Entries of a worker's word cache; beyond it the cache starts anew.
CACHE_WORDS = 800_000
_encoders: dict[str, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}


_LETTERS = byte_letters()


class Encoder:
    """The tokenizer of a Python worker, with the ids of the words it has met."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.parts = Tokenizer(self.whole.model)
        self.parts.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        ends = [i for w, i in self.whole.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]
        self.is_end = np.zeros(self.whole.get_vocab_size(), bool)
        self.is_end[ends] = True
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encode lower-case words; the last id of each part is a word end, which shows where parts meet."""
        known = self.known
        split = [(w,) if w.isascii() and w.isalpha() else PARTS.findall(w) for w in words]
        new = list({p for parts in split for p in parts if p not in known})
        for at in range(0, len(new), 500):
            line = " ".join(new[at : at + 500])
            line = line if line.isascii() else " ".join(p.encode().decode("latin-1").translate(_LETTERS) for p in new[at : at + 500])
            ids = np.array(self.parts.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            raw = ids.tobytes()
            known.update(zip(new[at : at + 500], [raw[a:b] for a, b in zip([0, *stops], stops)], strict=True))
        for w, parts in zip(words, split):
            if len(parts) > 1:
                known[w] = b"".join([known[p] for p in parts])


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, as the tokenizer gives them for the whole text.

    The tokenizer lower-cases and never joins over white space, so words are encoded once and looked up.
    Texts with characters outside ``PLAIN``, or that may hold a special token, go to it whole.
    """
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    encoder, new = _encoders[path], set()
    split = [None if "<|" in t or not PLAIN.fullmatch(t) else t.lower().split() for t in texts]
    for words in split:
        if words:
            new.update(filterfalse(encoder.known.__contains__, words))
    if len(encoder.known) + len(new) > CACHE_WORDS:
        encoder.known.clear()
        new = {w for words in split if words for w in words}
    encoder.learn(list(new))
    return [
        np.array(encoder.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        if words is None
        else b"".join(map(encoder.known.__getitem__, words))
        for t, words in zip(texts, split)
    ]


def tokenize(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces ``(doc_id, start, length, doc_tokens, ids)`` of ``docs(doc_id, text)``; ids are little-endian 32-bit."""
    end, wide = np.array([end_id], "<u4").tobytes(), 4 * window

    def step(batch: pa.RecordBatch):
        ids = encode_texts([t or "" for t in batch.column("text").to_pylist()], tokenizer_path)
        out = {"doc_id": [], "start": [], "length": [], "doc_tokens": [], "ids": []}
        for key, raw in zip(batch.column("doc_id").to_pylist(), ids):
            raw += end
            for at in range(0, len(raw), wide):
                piece = raw[at : at + wide]
                out["doc_id"].append(key)
                out["start"].append(at // 4)
                out["length"].append(len(piece) // 4)
                out["doc_tokens"].append(len(raw) // 4)
                out["ids"].append(piece)
        yield out

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_steps(rows, step, "doc_id long, start long, length long, doc_tokens long, ids binary")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Non-negative least squares by an active set."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    gram, right = a.T @ a if a.shape[1] <= 2048 else None, a.T @ b
    tolerance = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds):
        slope = right - (gram @ x if gram is not None else a.T @ (a[:, active] @ x[active]))
        slope[active] = -np.inf
        new = int(slope.argmax())
        if slope[new] <= tolerance:
            break
        active[new] = True
        while True:
            own = np.flatnonzero(active)
            got = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if (got > 0).all():
                x[:] = 0
                x[own] = got
                break
            bad = got <= 0
            share = (x[own][bad] / np.maximum(x[own][bad] - got[bad], 1e-300)).min()
            x[own] += share * (got - x[own])
            gone = own[(x[own] <= 1e-12) | (bad & (x[own] <= 1e-9))]
            if not len(gone):
                gone = own[bad][:1]
            x[gone] = 0
            active[gone] = False
    return x


def combinations(sizes: list[int], full: int) -> list[dict[int, int]]:
    """Ways to fill ``full`` exactly with one size, repeated, and at most two smaller ones."""
    there, out = set(sizes), []
    for a in sizes:
        for times in range(1, full // a + 1):
            rest = full - times * a
            if not rest:
                out.append({a: times})
            for r in sizes:
                if r >= a or r > rest:
                    continue
                s = rest - r
                if s == 0:
                    out.append({a: times, r: 1})
                elif s <= r and s in there:
                    out.append({a: times, r: 2} if s == r else {a: times, r: 1, s: 1})
    return out


def plan(histogram: dict[int, int], full: int) -> list[tuple[int, dict[int, int]]]:
    """``(windows, {size: pieces in each})``; together they use the histogram up."""
    left, out = {k: n for k, n in histogram.items() if n}, []

    def use(count: int, mix: dict[int, int]) -> None:
        if count > 0:
            out.append((count, mix))
            for k, n in mix.items():
                left[k] -= n * count
                if not left[k]:
                    del left[k]

    if ways := combinations(sorted(left), full):
        place = {k: i for i, k in enumerate(sorted(left))}
        a = np.zeros((len(place), len(ways)))
        for j, mix in enumerate(ways):
            for k, n in mix.items():
                a[place[k], j] = n
        counts = np.floor(nnls(a, np.array([left[k] for k in sorted(left)], float)) + 1e-6).astype(int)
        for j in np.argsort(-counts, kind="stable"):
            if counts[j] <= 0:
                break
            use(min([int(counts[j]), *(left.get(k, 0) // n for k, n in ways[j].items())]), ways[j])
    while left:
        mix, room = {}, full
        for k in sorted(left, reverse=True):
            if n := min(left[k], room // k):
                mix[k], room = n, room - n * k
        use(min(left[k] // n for k, n in mix.items()), mix)
    return out


def pack(pieces: DataFrame, order: list[str], window: int = 4096, grid: int = 16, salts: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces``, a stored table with a column ``length`` from 1 to ``window``.

    ``order`` names the columns that fix the order of pieces; rows equal in all of them are interchangeable.
    """
    spark, full = pieces.sparkSession, -(-window // grid)
    salts = salts or min(4096, max(16, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sized = pieces.withColumn("_size", F.ceil(F.col("length") / grid).cast("int")).withColumn(
        "_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")
    )
    counts = sized.groupBy("_size", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    histogram = {r["_size"]: r["n"] for r in counts.groupBy("_size").agg(F.sum("_n").alias("n")).collect()}
    at, sequence, spans = dict.fromkeys(histogram, 0), 0, []
    for count, mix in plan(histogram, full):
        slot = 0
        for k in sorted(mix, reverse=True):
            spans.append((k, at[k], at[k] + count * mix[k], sequence, mix[k], slot))
            at[k], slot = at[k] + count * mix[k], slot + mix[k]
        sequence += count
    spans = spark.createDataFrame(spans, "_size int, _lo long, _hi long, _first long, _each int, _slot int")
    before = counts.select(
        "_size", "_salt",
        (F.sum("_n").over(Window.partitionBy("_size").orderBy("_salt")) - F.col("_n")).alias("_before"),
    )
    rank = F.row_number().over(Window.partitionBy("_size", "_salt").orderBy(*order)) - 1
    # At most grid sizes times salts, and grid sizes times patterns, rows: both stay small at any corpus size.
    placed = (
        sized.withColumn("_rank", rank)
        .join(F.broadcast(before), ["_size", "_salt"])
        .withColumn("_rank", F.col("_rank") + F.col("_before"))
        .join(F.broadcast(spans), ["_size"])
        .where("_rank >= _lo AND _rank < _hi")
        .withColumn("sequence_id", F.expr("_first + (_rank - _lo) div _each"))
        .withColumn("_slot", F.expr("_slot + (_rank - _lo) % _each"))
    )
    inside = Window.partitionBy("sequence_id").orderBy("_slot")
    return placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).select(
        *pieces.columns, "sequence_id", "offset"
    )
