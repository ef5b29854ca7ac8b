"""Document fingerprints by locally consistent parsing.

A text's bytes are the symbols of the first level. On each level runs of one symbol
are collapsed; deterministic coin tossing gives each symbol a label from the lowest
bit in which it differs from its left neighbour, repeated until labels are below 6;
a phrase begins where a label exceeds both neighbours; and a phrase's name, a hash of
its symbols and run lengths, is a symbol of the next level. A name depends on a few
symbols around it alone, so equal substrings share the names in their interior at
whatever offset. The fingerprint keeps, of the names of the levels ``LEVELS``, the
least of each of 64 classes as 16 bits; likeness is the share of classes on which two
fingerprints agree among those that either has.

Null texts are empty; the fingerprint of an empty text has no class, and is like
another empty one only. Null ids sort before all others; rows of one id sort by text;
repeated rows are fingerprinted each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STEP_BYTES, importable

#: Levels whose names are kept; a phrase of level 2 spans about ten bytes.
LEVELS, CLASSES, NONE = (2, 3), 64, 0xFFFF
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _toss(now: int, left: int) -> int:
    """One toss of unlike labels: twice the lowest differing bit's place, and the bit."""
    d = now ^ left
    place = (d & -d).bit_length() - 1 if d else 0
    return 2 * place + (now >> place & 1)


def _table(bits: int) -> np.ndarray:
    return np.array([_toss(i >> bits, i & ((1 << bits) - 1)) for i in range(1 << 2 * bits)], np.uint8)


_TOSS = {bits: _table(bits) for bits in (3, 4, 7, 8)}
_BYTES = mix(np.arange(256, dtype=np.uint64) + _ODD)
_PLACES = np.array([pow(0xD1B54A32D192ED03, i, 1 << 64) for i in range(64)], np.uint64)


def _shift(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Left neighbours; the first symbol of a text has a neighbour that differs from it in the lowest bit."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = x[first] ^ x.dtype.type(1)
    return left


def labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 6, unlike between neighbours."""
    if x.dtype == np.uint8:
        out, bits = x, (8, 4, 3)
    else:
        left = _shift(x, first)
        d = x ^ left
        place = (((d & (~d + np.uint64(1))).astype(np.float64).view(np.uint64)) >> np.uint64(52)) - np.uint64(1023)
        out, bits = (2 * place + ((x >> place) & np.uint64(1))).astype(np.uint8), (7, 4, 3)
    for b in bits:
        out = _TOSS[b][(out.astype(np.uint16) << np.uint16(b)) | _shift(out, first)]
    return out


def parse(x: np.ndarray, first: np.ndarray, named: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of texts that begin at ``first`` (no text is empty), and where each text begins now."""
    kept = np.empty(len(x), bool)
    kept[0] = True
    np.not_equal(x[1:], x[:-1], out=kept[1:])
    kept[first] = True
    at = np.flatnonzero(kept)
    run = np.diff(np.append(at, len(x)))
    symbols = x[at]
    first = np.searchsorted(at, first)
    names = (_BYTES[symbols] if symbols.dtype == np.uint8 else mix(symbols)) + (run - 1).astype(np.uint64) * _ODD
    lab = labels(symbols, first)
    begin = np.zeros(len(lab), bool)
    begin[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] > lab[2:])
    begin[first] = True
    second = first + 1
    begin[second[second < len(lab)]] = False  # no phrase of one symbol at a text's head
    begin[first[1:] - 1] = False  # a text's last symbol has no right neighbour
    begin[first] = True
    starts = np.flatnonzero(begin)
    sizes = np.diff(np.append(starts, len(lab)))
    offset = np.arange(len(lab)) - np.repeat(starts, sizes)
    out = mix(np.add.reduceat(mix(names) * _PLACES[np.minimum(offset, 63)], starts) + sizes.astype(np.uint64))
    return out, np.searchsorted(starts, first)


def sketches(texts: list[bytes]) -> np.ndarray:
    """One row of ``CLASSES`` 16-bit values for each text."""
    out = np.full((len(texts), CLASSES), NONE, np.uint16)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    there = np.flatnonzero(sizes)
    if not len(there):
        return out
    x = np.frombuffer(b"".join(texts), np.uint8)
    first = (np.cumsum(sizes) - sizes)[there]
    least = np.full(len(there) * CLASSES, np.iinfo(np.uint32).max, np.uint32)
    for level in range(1, max(LEVELS) + 1):
        x, first = parse(x, first)
        if level in LEVELS:
            h = mix(x + np.uint64(level))
            text = np.repeat(np.arange(len(there)), np.diff(np.append(first, len(x))))
            np.minimum.at(least, text * CLASSES + (h >> np.uint64(58)).astype(np.int64), (h & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    none = least == np.iinfo(np.uint32).max
    # The kept 16 bits come from a further mix, for the least values begin with zeros.
    values = (mix(least.astype(np.uint64) + _ODD) % np.uint64(NONE)).astype(np.uint16)
    out[there] = np.where(none, NONE, values).reshape(len(there), CLASSES)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of classes on which rows agree among those that either has; 1 where neither has any."""
    either = ((a != NONE) | (b != NONE)).sum(1)
    return np.where(either == 0, 1.0, ((a == b) & (a != NONE)).sum(1) / np.maximum(either, 1))


def in_hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(rows: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
    """Results of consecutive documents; ``following`` is the text after the last."""
    texts = [t for _, t in rows] + [following]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, texts[1:])]
    raw = [e.encode() for e in edited]
    own, new = sketches([t.encode() for t in texts]), sketches(raw)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(r).hexdigest() for r in raw]), pa.array(in_hex(own[:-1])), pa.array(in_hex(new)),
            pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:])),
        ],
        names=[f.split()[0] for f in SCHEMA.split(", ")],
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint)`` for each row of ``docs(doc_id, text)``."""
    from .common import map_steps

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_steps(
        rows,
        lambda b: iter([{"doc_id": b.column("doc_id"), "fingerprint": in_hex(sketches([(t or "").encode() for t in b.column("text").to_pylist()]))}]),
        "doc_id long, fingerprint string",
    )


def against_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of texts, of their edits with the next text in order of id, and their likeness (``SCHEMA``).

    Texts are dealt by ranges of ids and sorted within them, one shuffle; a range's last row finds its next text in
    the first row of the following range, which is sent to both.
    """
    importable(docs.sparkSession)
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(lowest)))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(rows.agg(F.percentile_approx("_key", shares, 20 * parts)).first()[0] or [])) if shares else []
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def part_of(keys):
        import pandas as pd

        return pd.Series(np.searchsorted(edges, keys.to_numpy(np.int64), side="left").astype(np.int32))

    dealt = rows.withColumn("_part", part_of("_key"))
    heads = sorted(tuple(r) for r in dealt.groupBy("_part").agg(F.min("_key")).collect())  # a row for each part
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    before = {key: heads[i - 1][0] for i, (_, key) in enumerate(heads)}
    ghosts = rows.join(F.broadcast(spark.createDataFrame(list(before.items()), "_key long, _part int")), "_key")
    both = dealt.select("_part", F.lit(0).alias("_ghost"), "_key", "doc_id", "text").unionByName(ghosts.select("_part", F.lit(1).alias("_ghost"), "_key", "doc_id", "text"))
    ordered = both.repartition(parts, "_part").sortWithinPartitions("_part", "_ghost", "_key", "text").select("_part", "_ghost", "doc_id", "text")

    def run(batches):
        held, size, part, done = [], 0, None, False
        for batch in batches:
            for p, ghost, key, text in zip(*(batch.column(c).to_pylist() for c in ("_part", "_ghost", "doc_id", "text"))):
                if p != part:
                    held, size, part, done = [], 0, p, False
                if done:
                    continue
                if ghost or size > STEP_BYTES:
                    if held:
                        yield compare(held, text)
                    held, size, done = [], 0, bool(ghost)
                if not ghost:
                    held.append((key, text))
                    size += len(text)

    return ordered.mapInArrow(run, SCHEMA)
