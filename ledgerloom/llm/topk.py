"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of bounded size. A block has, for each dimension, its
rows in order of that component. For a query the lists are read in step, from the
large end where the query's component is positive and from the small end where it
is negative; each row met is scored in full. The components at the lists' present
depth bound the score of every row not met yet, and reading stops once that bound
is below the kth score. Equal bounds read on, for ties go to the smaller id. The
best of all blocks are merged per query.

In tens of dimensions with no dominant one the bound falls late and most rows of a
block are met; the result is exact all the same. The sorted lists of a block are
built once, in one task, and all queries stream past them.

Rows whose id or vector is null, whose vector is empty or holds null or non-finite
components take no part; vectors of another length than the query's are not
compared; rows with the query's own id are no candidates; repeated candidate rows
count each. Equal query rows are one query; unlike query rows of one id pool their
candidates, one entry for each of them. Ties go to the smaller id. There are no
texts; other columns are not read; an empty table of either gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import importable

#: Rows of a block of vectors at most, and of a block of queries.
BLOCK, QUERIES = 16_384, 1024


def scaled(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, values)``: components as floor(scale * x), of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("values")
    )


def _blocks(rows: DataFrame, count: int) -> DataFrame:
    """One row ``(dims, block, ids, values)`` for each of ``count`` blocks and each length of vectors."""

    def gather(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        flat = np.concatenate([c.flatten().to_numpy() for c in table.column("values").chunks] or [np.zeros(0, np.int64)])
        return pa.table(
            {
                "dims": table.column("dims").slice(0, 1), "block": table.column("block").slice(0, 1),
                "ids": pa.array([table.column("vec_id").to_numpy().astype("<i8").tobytes()], pa.binary()),
                "values": pa.array([flat.astype("<i8").tobytes()], pa.binary()),
            }
        )

    # Row numbers of the scan deal repeated ids out too.
    dealt = rows.withColumn("block", F.pmod(F.hash(F.monotonically_increasing_id()), F.lit(count)).cast("int"))
    return (
        dealt.withColumn("dims", F.size("values"))
        .groupBy("dims", "block")
        .applyInArrow(gather, "dims int, block int, ids binary, values binary")
    )


class Lists:
    """The sorted lists of one block."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.values = values
        self.up = np.ascontiguousarray(np.argsort(values, axis=0, kind="stable").astype(np.int32))
        self.low = np.take_along_axis(values, self.up, 0)
        self.widest = int(np.abs(values).max(initial=0))

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those of id ``own``."""
        rise, fall = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        # Below 2**53 sums of doubles are exact, and faster.
        exact = self.widest * int(np.abs(query).max(initial=0)) * len(query) < 1 << 53
        values, q = (self.values.astype(np.float64), query.astype(np.float64)) if exact else (self.values, query)
        if exact and not hasattr(self, "doubles"):
            self.doubles = values
        values = self.doubles if exact else values
        met, scores = np.zeros(self.n, bool), np.full(self.n, -np.inf if exact else np.iinfo(np.int64).min)
        barred, depth = self.ids == own, 8
        while True:
            depth = min(depth, self.n)
            now = np.zeros(self.n, bool)
            now[self.up[:depth][:, fall]] = True
            now[self.up[self.n - depth :][:, rise]] = True
            if depth == self.n:
                now[:] = True
            new = np.flatnonzero(now & ~met & ~barred)
            met |= now
            scores[new] = values[new] @ q
            if depth == self.n or met.all():
                break
            there = int((met & ~barred).sum())
            if there >= k:
                kth = np.partition(scores, self.n - k)[self.n - k]
                bound = self.low[self.n - depth, rise] @ query[rise] + self.low[depth - 1, fall] @ query[fall]
                if bound < kth:
                    break
            depth *= 2
        there = np.flatnonzero(met & ~barred)
        if len(there) > k:
            there = there[scores[there] >= np.partition(scores[there], len(there) - k)[len(there) - k]]
        there = there[np.lexsort((self.ids[there], -scores[there]))][:k]
        return self.ids[there], scores[there].astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best of ``vectors(vec_id, values)`` for each row of ``queries``.

    Scores are inner products of the integer components, which must stay below 2**63.
    """
    importable(vectors.sparkSession)
    queries = queries.select("vec_id", "values").distinct()
    n = vectors.count()
    # Small tables are cut into as many blocks as there are tasks at once, if that leaves 512 rows to each.
    count = max(1, -(-n // block), min(vectors.sparkSession.sparkContext.defaultParallelism, n // 512))
    q = _blocks(queries, max(1, -(-queries.count() // query_block))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    both = _blocks(vectors, count).withColumn("kind", F.lit(0)).unionByName(q.withColumn("kind", F.lit(1)))
    met = both.repartition(count, "dims", "block").sortWithinPartitions("dims", "block", "kind")

    def search(batches):
        at, lists = None, None
        for batch in batches:
            for dims, block, kind, ids, values in zip(*(batch.column(c).to_pylist() for c in ("dims", "block", "kind", "ids", "values"))):
                ids, values = np.frombuffer(ids, "<i8"), np.frombuffer(values, "<i8").reshape(-1, dims)
                if not kind:
                    at, lists = (dims, block), Lists(ids, values)
                elif at == (dims, block):
                    found = [(i, *lists.best(x, i, k)) for i, x in zip(ids, values)]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "query_id": np.repeat([i for i, _, _ in found], [len(x) for _, x, _ in found]).astype(np.int64),
                            "vec_id": np.concatenate([x for _, x, _ in found]),
                            "score": np.concatenate([s for _, _, s in found]),
                        }
                    )

    best = met.select("dims", "block", "kind", "ids", "values").mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
