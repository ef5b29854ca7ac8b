"""Product codes of vectors by ball k-means: exact nearest entries with few distances.

Components become integers and each vector is cut into parts with a codebook of their own. A codebook's entries start as
the parts of the first vectors by id; each round assigns every part to its nearest entry and moves entries to their
parts' floored mean. The first assignment measures all entries. After that, within each block of vectors, the parts of
an entry form a *ball* around the moved entry, whose radius is its farthest part. Only entries within two radii can win a
part from it, and they are its neighbours; a part nearer to its entry than half the way to the nearest neighbour lies in
the ball's stable *core* and is not looked at; the others fall in *rings* by how many neighbours lie within twice their
distance, and each is measured against those alone. Bounds include equality, so ties go to the lower index as in a full
search, and all arithmetic is on integers.

A block is one stored row of up to ``BLOCK`` vectors, rewritten with each round's codes and the sums of its parts, so a
round is one pass without a shuffle of vectors. Only codebooks (``parts * entries`` vectors) go through the driver.

Vectors that are null, or empty, or hold null or non-finite components, or components of 2**18 and more, take no part,
nor do those of another length than the least id's. Null ids come after all others, ids with several rows by their
vectors; each row is a vector of its own. With fewer rows than ``entries`` the codebooks have as many entries as there
are rows. A length that the parts do not divide is cut at floor(i * length / parts). An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, importable, materialize, salted_join

#: Vectors of a block, and what components are multiplied by.
BLOCK, SCALE = 4096, 1024
#: Scaled components stay below this, so that squared distances of up to 64 components a part fit 64 bits.
LIMIT = 1 << 26

Books = list[np.ndarray]


def whole_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``(vec_id, label, v)`` with scaled integer vectors, of the rows that take part."""
    x = F.col(column).cast("array<double>")
    scaled = F.transform(x, lambda c: F.floor(c * SCALE))
    usable = (F.size(x) > 0) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LIMIT // SCALE), F.lit(False)))
    label = F.coalesce(F.col("label").cast("string"), F.lit(""))  # nulls are one label
    return rows.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), scaled.alias("v"))


def cuts(length: int, parts: int) -> list[int]:
    return [i * length // parts for i in range(parts + 1)]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``x`` to each of ``entries``, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:  # all sums are whole numbers that a double holds
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(x), len(entries)), np.int64)
    for j, e in enumerate(entries):
        out[:, j] = ((x - e) ** 2).sum(1)
    return out


def ball_assign(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row of ``x``, its squared distance, and how many distances to other entries were measured.

    ``code`` is any assignment; the better it is, the fewer are measured.
    """
    own = ((x - entries[code]) ** 2).sum(1)
    between = distances(entries, entries)
    radius = np.zeros(len(entries), np.int64)
    np.maximum.at(radius, code, own)
    best, at, measured = own.copy(), code.copy(), 0
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(entries) + 1))
    for i in np.flatnonzero(np.diff(starts)):
        rows = order[starts[i] : starts[i + 1]]
        near = np.argsort(between[i], kind="stable")
        near = near[(near != i) & (between[i][near] <= 4 * radius[i])]  # neighbours, by distance
        rings = np.searchsorted(between[i][near], 4 * own[rows], "right")  # how many of them can win each row
        rows, rings = rows[rings > 0], rings[rings > 0]  # the rest are in the core
        by = np.argsort(-rings, kind="stable")
        rows, rings = rows[by], rings[by]
        low = 0
        while low < len(near):
            # The neighbours of some further rings at a time, with the rows that reach the first of these.
            high = min(max(2 * low, 1), len(near))
            some = rows[: np.searchsorted(-rings, -low)]
            if not len(some):
                break
            inside = rings[: len(some), None] > np.arange(low, high)
            d = np.where(inside, distances(x[some], entries[near[low:high]]), np.iinfo(np.int64).max)
            measured += int(inside.sum())
            least = d.min(1)
            # Of equal distances the lowest index.
            j = np.where(d == least[:, None], near[low:high], len(entries)).min(1)
            wins = (least < best[some]) | ((least == best[some]) & (j < at[some]))
            best[some[wins]], at[some[wins]] = least[wins], j[wins]
            low = high
    return at, best, measured


def _block(x: np.ndarray, books: Books, codes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of the rows of ``x``, errors, and measured distances; without codes all entries are measured."""
    at = cuts(x.shape[1], len(books))
    new, errors, measured = np.empty((len(x), len(books)), np.uint8), np.zeros(len(x), np.int64), 0
    for p, entries in enumerate(books):
        part = x[:, at[p] : at[p + 1]]
        if codes is None:
            d = distances(part, entries)
            found, best, n = d.argmin(1), d.min(1), d.size
        else:
            found, best, n = ball_assign(part, entries, codes[:, p].astype(np.int64))
        new[:, p], measured = found, measured + n
        errors += best
    return new, errors, measured


def _sums(x: np.ndarray, codes: np.ndarray, books: Books) -> np.ndarray:
    """For each part and entry the parts' sum and, last, their number; flat, codebook after codebook."""
    at, out = cuts(x.shape[1], len(books)), []
    for p, entries in enumerate(books):
        total = np.zeros((len(entries), entries.shape[1] + 1), np.int64)
        np.add.at(total, codes[:, p], np.column_stack([x[:, at[p] : at[p + 1]], np.ones(len(x), np.int64)]))
        out.append(total.ravel())
    return np.concatenate(out)


_STATE = "ids array<bigint>, labels array<string>, v binary, codes binary, errors array<bigint>, sums binary, measured bigint"


def _blocks(vectors: DataFrame, length: int) -> DataFrame:
    """Rows of up to ``BLOCK`` vectors of one length, as 32-bit integers."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                v = part.column("v").flatten().to_numpy().astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("label").to_pylist()], pa.list_(pa.string())), pa.array([v], pa.binary())],
                    ["ids", "labels", "v"],
                )

    return vectors.where(F.size("v") == length).mapInArrow(gather, "ids array<bigint>, labels array<string>, v binary")


def _assigned(blocks: DataFrame, books: Books, length: int, first: bool) -> DataFrame:
    """The blocks with codes for ``books``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                x = np.frombuffer(row.column("v")[0].as_py(), "<i4").astype(np.int64).reshape(-1, length)
                old = None if first else np.frombuffer(row.column("codes")[0].as_py(), np.uint8).reshape(len(x), -1)
                codes, errors, measured = _block(x, books, old)
                sums = _sums(x, codes, books).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [row.column("ids"), row.column("labels"), row.column("v"), pa.array([codes.tobytes()], pa.binary()), pa.array([errors.tolist()], pa.list_(pa.int64())), pa.array([sums], pa.binary()), pa.array([measured], pa.int64())],
                    ["ids", "labels", "v", "codes", "errors", "sums", "measured"],
                )

    return blocks.mapInArrow(run, _STATE)


def _moved(state: DataFrame, books: Books) -> Books:
    """Entries at the floored mean of their parts; unused ones stay."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for sums in batch.column("sums").to_pylist():
                found = np.frombuffer(sums, "<i8")
                total = found.copy() if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["slot", "total"])

    found = state.select("sums").mapInArrow(add, "slot int, total bigint").groupBy("slot").agg(F.sum("total").alias("total")).toPandas()
    flat, out, at = found.sort_values("slot")["total"].to_numpy(), [], 0
    for entries in books:
        total = flat[at : at + len(entries) * (entries.shape[1] + 1)].reshape(len(entries), -1)
        at += total.size
        n = total[:, -1:]
        out.append(np.where(n > 0, total[:, :-1] // np.maximum(n, 1), entries))
    return out


def train(rows: DataFrame, entries: int = 256, rounds: int = 4, parts: int = 4) -> tuple[Books, DataFrame | None]:
    """Codebooks, and stored blocks with final codes and errors, from ``rows(vec_id, label, embedding)``; at most 256 entries."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte a part")
    importable(rows.sparkSession)
    vectors = whole_vectors(rows)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    least = vectors.orderBy(*order).limit(1).collect()
    if not least:
        return [], None
    length = len(least[0]["v"])
    start = vectors.where(F.size("v") == length).orderBy(*order).limit(entries).collect()
    at = cuts(length, parts)
    first = np.array([r["v"] for r in start], np.int64)
    books = [first[:, at[p] : at[p + 1]] for p in range(parts)]
    state, reread = _blocks(vectors, length), None
    for turn in range(rounds + 1):
        new = materialize(_assigned(state, books, length, turn == 0), "codes")
        if reread is not None:
            discard(reread)
        state = reread = new
        if turn < rounds:
            books = _moved(state, books)
    return books, state


def digest(books: Books) -> str:
    """SHA-256 of all entries' components by part, entry and position, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(c) for entries in books for c in entries.ravel().tolist()).encode()).hexdigest()


def encode(rows: DataFrame, entries: int = 256, rounds: int = 4, parts: int = 4) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` for each vector that takes part.

    ``code`` has two hex digits a part; ``label_error`` is the sum of errors of the rows with an equal label.
    """
    books, state = train(rows, entries, rounds, parts)
    if state is None:
        return rows.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    text = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.lower(F.hex(F.substring("codes", i * parts + 1, F.lit(parts)))))
    rows = state.select(F.explode(F.arrays_zip("ids", "labels", "errors", text.alias("code"))).alias("_x"))
    found = rows.select(F.col("_x.ids").alias("vec_id"), F.col("_x.labels").alias("label"), F.col("_x.code").alias("code"), F.col("_x.errors").alias("error"))
    found = materialize(found, "vectors")
    discard(state)
    of_label = found.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = salted_join(found, of_label, "label", "vec_id")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
