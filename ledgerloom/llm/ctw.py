"""Language-model scoring by context-tree weighting over bytes.

Texts have A-Z in lower case and end with the byte 0xFF, which no text holds; they begin after a context of bytes
0xFE. Each byte is eight binary decisions; a decision has a context tree over the bytes before it, up to ``depth`` of
them. Every node keeps the counts of its decisions in the training texts, their Krichevsky-Trofimov estimate KT, and
the weighted probability

    Pw = 1/2 KT(node) + 1/2 prod Pw(children),        Pw = KT at the deepest level.

The probability of a decision in a text is Pw with it over Pw without it: along its path, from the deepest node up,

    p = w KT' + (1 - w) p(child),        w = 1/2 KT / Pw,

with KT' = (b + 1/2) / (a + b + 1) the estimate of a 1 after a zeros and b ones. An unseen node gives 1/2. That is the
exact mixture over all prunings of the tree; the model is fixed while texts are scored. ``score`` is the sum of the
log10 probabilities of a text's bytes and its end, so it is the probability of the whole text, as ``base_score`` is.

The tree is a distributed table of any size, and no model is broadcast or collected. A first pass cuts the input into
chunks of about ``CHUNK_BYTES`` of text, stores each chunk's texts beside its distinct byte runs and words, and counts
those of the training texts; a counted run or word keeps the list of its chunks. Runs that agree in the ``HEAD`` bytes before the last form one subtree; subtrees are
dealt over tasks, which read them in slices and work on arrays. The levels above are aggregates over the subtrees'
roots. Each chunk then meets the values of its runs and the counts of its words. Words serve the unigram base and are
matched by 63-bit hashes.

Null and empty texts are scored as an end alone. Rows whose id is null are scored as well; where ``trains`` is null a
row is held out. Ties do not occur, for every row has its own result; repeated rows count each. A very long text is a
chunk of its own, whole. An empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, importable, materialize, steps

#: Bytes of context; of these, the bytes that deal subtrees over tasks.
DEPTH, HEAD = 5, 3
#: Text bytes of a chunk, and byte runs of a slice of subtrees.
CHUNK_BYTES, SLICE = 16 << 20, 400_000
#: Text bytes that are cut into runs at a time, and those that are scored; some numbers are held for each.
READ_BYTES, SCORED_BYTES = 1 << 20, 512 << 10
START, END = b"\xfe", b"\xff"
_SIGN = 1 << 63
_SMALL = 1 << 16
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 0.5))])
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_SMALL) + 1.0))])


def words_of(raw: bytes) -> list[bytes]:
    """Words between ASCII white space of a text in lower case."""
    return raw.split()


def raw_of(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return (text or "").encode().lower()


def runs(raws: list[bytes], depth: int) -> np.ndarray:
    """For each byte and each end, the number whose last byte it is and whose other bytes are the ``depth`` before it."""
    data = np.frombuffer(b"".join(START * depth + r + END for r in raws), np.uint8)
    sizes = np.fromiter((len(r) + 1 + depth for r in raws), np.int64, len(raws))
    out = np.zeros(max(len(data) - depth, 0), np.int64)
    for i in range(depth + 1):
        out = (out << 8) | data[i : len(data) - depth + i]
    # Positions in which another text's context would begin are left out.
    starts = np.cumsum(sizes) - sizes
    keep = np.ones(len(data), bool)
    for i in range(depth):
        keep[starts + i] = False
    return out[keep[depth:]] if len(data) > depth else out[:0]


def word_key(word: bytes) -> int:
    """A negative number: 63 bits of XXH64."""
    from xxhash import xxh64_intdigest

    return (xxh64_intdigest(word) | _SIGN) - (1 << 64)


def packed(table: pa.RecordBatch) -> bytes:
    """Ids, training marks and texts of some rows, compressed: they are stored and dealt once each."""
    sink = pa.BufferOutputStream()
    table = table.select(["doc_id", "trains", "text"])
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as to:
        to.write_batch(table)
    return sink.getvalue().to_pybytes()


def unpacked(texts: pa.Table):
    """The rows of :func:`packed`, in batches."""
    for one in texts.column("texts"):
        yield from pa.ipc.open_stream(one.as_buffer())


class Chunk:
    """Texts of one chunk, and what they hold: byte runs and words with their counts in training."""

    def __init__(self, number: int, depth: int):
        self.number, self.depth, self.size = number, depth, 0
        self.texts, self.keys, self.counts, self.words = [], [], [], Counter()

    def add(self, table: pa.RecordBatch) -> None:
        raws = [raw_of(t) for t in table.column("text").to_pylist()]
        trains = table.column("trains").to_pylist()
        for own in (True, False):
            part = [r for r, t in zip(raws, trains) if t == own]
            keys, counts = np.unique(runs(part, self.depth), return_counts=True)
            self.keys.append(keys)
            self.counts.append(counts if own else np.zeros(len(keys), np.int64))
            for r in part:
                if own:
                    self.words.update(words_of(r))
                else:
                    self.words.update(dict.fromkeys(words_of(r), 0))
        self.texts.append((packed(table), sum(trains)))
        self.size += sum(map(len, raws))

    def batches(self):
        for texts, n in self.texts:
            yield self._batch(1, texts=pa.array([texts], pa.binary()), n=pa.array([n]))
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        self.keys, self.counts = [], []
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        del order
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
        keys, counts = keys[begin], np.add.reduceat(counts, begin) if len(keys) else counts
        words = np.fromiter(map(word_key, self.words), np.int64, len(self.words))
        keys, counts = np.concatenate([keys, words]), np.concatenate([counts, np.fromiter(self.words.values(), np.int64, len(words))])
        for a in range(0, len(keys), 100_000):
            yield self._batch(len(keys[a : a + 100_000]), key=pa.array(keys[a : a + 100_000]), n=pa.array(counts[a : a + 100_000]))

    def _batch(self, size: int, **columns: pa.Array) -> pa.RecordBatch:
        kinds = {"chunk": pa.int64(), "key": pa.int64(), "n": pa.int64(), "texts": pa.binary()}
        columns["chunk"] = pa.array(np.full(size, self.number, np.int64))
        return pa.RecordBatch.from_arrays([columns[c].cast(k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()], names=list(kinds))


def gather(docs: DataFrame, trains: Column, depth: int) -> DataFrame:
    """``(chunk, key, n, texts)``: rows with a null key hold some :func:`packed` texts and how many of them train; one for
    each byte run (key 0 or more) and word (key below 0) of a chunk has its count in training."""
    given = docs.select(
        F.spark_partition_id().cast("long").alias("part"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"),
    )

    def run(batches):
        chunk = None
        for batch in steps(batches, "text", READ_BYTES):
            if chunk is None:
                chunk = Chunk(batch.column("part")[0].as_py() << 32, depth)
            chunk.add(batch)
            if chunk.size >= CHUNK_BYTES:
                yield from chunk.batches()
                chunk = Chunk(chunk.number + 1, depth)
        if chunk is not None and chunk.texts:
            yield from chunk.batches()

    return given.mapInArrow(run, "chunk long, key long, n long, texts binary")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of any sequence of a zeros and b ones."""

    def part(n: np.ndarray, table: np.ndarray, add: float, less: float) -> np.ndarray:
        out = table[np.minimum(n, _SMALL)]
        far = n > _SMALL
        if far.any():
            out = np.where(far, _log_gamma(np.maximum(n, 1) + add) - less, out)
        return out

    half = math.lgamma(0.5)
    return part(a, _HALF, 0.5, half) + part(b, _HALF, 0.5, half) - part(a + b, _WHOLE, 1.0, 0.0)


def subtrees(keys: np.ndarray, counts: np.ndarray, depth: int, head: int) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """All levels from ``depth`` to ``head`` over distinct sorted byte runs, which hold whole subtrees.

    Gives for each of the eight decisions of each run the node at ``head`` and the weighted probability there of a 1,
    and the nodes at ``head`` as ``(nodes, a, b, log Pw)`` for each decision.
    """
    levels, places = [(keys, counts)], [np.arange(len(keys))]
    for d in range(depth - 1, head - 1, -1):
        above, up = np.unique(levels[-1][0] & ((1 << (8 * d + 8)) - 1), return_inverse=True)
        levels.append((above, np.bincount(up, levels[-1][1], len(above)).astype(np.int64)))
        places.append(up)
    at_head, ones, roots = np.empty((len(keys), 8), np.int64), np.empty((len(keys), 8)), []
    for k in range(8):
        pw = None
        for i, (names, n) in enumerate(levels):
            prefix = names >> (8 - k)
            begin = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1]))
            group = np.zeros(len(names), np.int64)
            group[begin[1:]] = 1
            group = np.cumsum(group)
            bit = (names >> (7 - k)) & 1
            b = np.add.reduceat(n * bit, begin)
            a = np.add.reduceat(n, begin) - b
            kt, one = log_kt(a, b), (b + 0.5) / (a + b + 1.0)
            if i == 0:
                pw, p, to, below = kt, one[group], np.arange(len(keys)), group
            else:
                to = places[i][to]
                # A node's children: the groups of the level below, each by any of its runs.
                first = np.flatnonzero(np.append(True, below[1:] != below[:-1]))
                kids = np.bincount(group[places[i][first]], pw, len(begin))
                own = 1.0 / (1.0 + np.exp(np.minimum(kids - kt, 700.0)))
                pw = math.log(0.5) + np.logaddexp(kt, kids)
                here = group[to]
                p = own[here] * one[here] + (1 - own[here]) * p
                below = group
        nodes = ((names[begin] >> 8) << 8) | (1 << k) | ((names[begin] & 255) >> (8 - k))
        roots.append((nodes, a, b, pw))
        at_head[:, k], ones[:, k] = nodes[group[to]], p
    return at_head, ones, roots


def _dealt(rows: DataFrame, n_runs: int) -> DataFrame:
    """Rows dealt by their column ``head`` and sorted by it and ``kind``."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_runs // 2_000_000))
    return rows.repartition(parts, "head").sortWithinPartitions("head", "kind", "key")


def _slices(batches, size: int = SLICE):
    """Tables that hold whole heads, of about ``size`` rows or one head."""
    held, n = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < size:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        heads = table.column("head").to_numpy()
        cut = int(np.searchsorted(heads_rank(heads), heads_rank(heads)[-1], side="left"))
        if cut:
            yield table.slice(0, cut)
        held, n = table.slice(cut).to_batches(), len(table) - cut
        size = max(SLICE, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def heads_rank(heads: np.ndarray) -> np.ndarray:
    """Running number of a sorted column's values."""
    return np.cumsum(np.append(0, heads[1:] != heads[:-1]))


def log_kt_column(a: Column, b: Column) -> Column:
    """:func:`log_kt` as a column, by Stirling's series after a shift by 8."""

    def log_gamma(x: Column) -> Column:
        shifted, product = x + 8, x
        for i in range(1, 8):
            product = product * (x + i)
        inverse = F.lit(1.0) / shifted
        series = inverse / 12 - F.pow(inverse, 3) / 360 + F.pow(inverse, 5) / 1260
        return (shifted - 0.5) * F.log(shifted) - shifted + 0.5 * math.log(2 * math.pi) + series - F.log(product)

    estimate = log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)
    return F.when(a + b == 0, F.lit(0.0)).otherwise(estimate)


def upper(roots: DataFrame, head: int) -> DataFrame:
    """``(node, sum, rest)`` for each root ``(node, a, b, pw)``: a 1 has the probability sum + rest * that of the root."""
    levels, level = [], roots
    for d in range(head - 1, -1, -1):
        mask = (1 << (8 * d + 8)) - 1
        up = level.groupBy(F.col("node").bitwiseAND(F.lit(mask)).alias("node")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("kids"))
        up = up.withColumn("kt", log_kt_column(F.col("a").cast("double"), F.col("b").cast("double")))
        most = F.greatest("kt", "kids")
        both = math.log(0.5) + most + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("kids"))))
        own = F.lit(1.0) / (1.0 + F.exp(F.least(F.col("kids") - F.col("kt"), F.lit(700.0))))
        level = materialize(up.select("node", "a", "b", both.alias("pw"), own.alias("own")), f"tree-{d}")
        levels.insert(0, level)
    kt = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
    now = levels[0].select("node", (F.col("own") * kt).alias("sum"), (1 - F.col("own")).alias("rest")) if levels else roots.select("node", F.lit(0.0).alias("sum"), F.lit(1.0).alias("rest"))
    for d in range(1, head + 1):
        # Node numbers of the level above keep the low bytes of the context.
        here = (levels[d] if d < head else roots).withColumn("above", F.col("node").bitwiseAND(F.lit((1 << (8 * d)) - 1)))
        met = here.hint("merge").join(now.select(F.col("node").alias("above"), F.col("sum").alias("s"), F.col("rest").alias("r")).hint("merge"), "above")
        own = F.col("own") if d < head else F.lit(0.0)
        now = met.select("node", (F.col("s") + F.col("r") * own * kt).alias("sum"), (F.col("r") * (1 - own)).alias("rest"))
    now = materialize(now, "upper")
    discard(*levels)
    return now


def costs(grams: DataFrame, depth: int, head: int) -> DataFrame:
    """The log10 probability of each of ``grams(key, n, chunks)``: its last byte after the others.

    ``(chunk, gaps, values)``: some runs of a chunk as :func:`turn` gives them, each less the one before, and their values.
    """
    n_runs = grams.count()
    low = (1 << (8 * head)) - 1
    mine = grams.select(F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(low)).alias("head"), F.lit(1).alias("kind"), "key", "n", F.lit(None).cast("double").alias("sum"), F.lit(None).cast("double").alias("rest"), "chunks")

    def tops(batches):
        for table in _slices(batches):
            keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
            order = np.argsort(keys)
            for nodes, a, b, pw in subtrees(keys[order], n[order], depth, head)[2]:
                yield pa.RecordBatch.from_pydict({"node": nodes, "a": a, "b": b, "pw": pw})

    roots = materialize(_dealt(mine, n_runs).select("head", "key", "n").mapInArrow(tops, "node long, a long, b long, pw double"), "roots")
    above = upper(roots, head)
    discard(roots)
    heads = above.select(F.shiftrightunsigned("node", 8).alias("head"), F.lit(0).alias("kind"), F.col("node").alias("key"), F.lit(None).cast("long").alias("n"), "sum", "rest", F.lit(None).cast("array<long>").alias("chunks"))

    def whole(batches):
        for table in _slices(batches):
            kind, keys = table.column("kind").to_numpy(), table.column("key").to_numpy()
            tops, own = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
            tops = tops[np.argsort(keys[tops])]
            own = own[np.argsort(keys[own])]
            sums, rests = (table.column(c).take(pa.array(tops)).to_numpy() for c in ("sum", "rest"))
            n = table.column("n").take(pa.array(own)).to_numpy().astype(np.int64)
            at, ones, _ = subtrees(keys[own], n, depth, head)
            place = np.searchsorted(keys[tops], at)
            p = sums[place] + rests[place] * ones
            bits = (keys[own][:, None] >> np.arange(7, -1, -1)) & 1
            value = np.log10(np.where(bits == 1, p, 1 - p)).sum(1)
            turned = turn(keys[own], depth, head)
            by = np.argsort(turned)
            lists = table.column("chunks").take(pa.array(own[by])).combine_chunks()
            of, to = np.repeat(by, pc.list_value_length(lists).to_numpy()), pc.list_flatten(lists).to_numpy()
            order = np.argsort(to, kind="stable")
            of, to = of[order], to[order]
            begin = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64)
            gaps = np.diff(turned[of], prepend=0)
            gaps[begin] = turned[of[begin]]
            ends = pa.array(np.append(begin, len(to)).astype(np.int32))
            lists = {"gaps": pa.ListArray.from_arrays(ends, pa.array(gaps)), "values": pa.ListArray.from_arrays(ends, pa.array(value[of]))}
            yield from pa.table({"chunk": to[begin], **lists}).to_batches(64)

    return _dealt(mine.unionByName(heads), n_runs).mapInArrow(whole, "chunk long, gaps array<long>, values array<double>")


def turn(keys: np.ndarray, depth: int, head: int) -> np.ndarray:
    """Byte runs with the bytes of their head moved to the front, so that those of one subtree are near each other."""
    low, far = (1 << (8 * head)) - 1, 8 * (depth - head)
    return ((keys >> 8 & low) << (far + 8)) | (keys >> (8 * head + 8) << 8) | (keys & 255)


def turn_back(turned: np.ndarray, depth: int, head: int) -> np.ndarray:
    far = 8 * (depth - head)
    return ((turned >> 8 & ((1 << far) - 1)) << (8 * head + 8)) | (turned >> (far + 8) << 8) | (turned & 255)


def score(docs: DataFrame, trains: Column, depth: int = DEPTH, head: int = HEAD) -> DataFrame:
    """Each row's ``(doc_id, trains, n_tokens, n_known, train_tokens, n_bytes, base_score, score)`` in log10.

    ``trains`` says which rows of ``docs(doc_id, text)`` the model learns from; all are scored. ``depth`` is at most 6.
    """
    if not 0 <= head <= depth <= 6:
        raise ValueError("depth is at most 6, and head at most depth")
    importable(docs.sparkSession)
    seen = materialize(gather(docs, trains, depth), "seen")
    # A key occurs once in a chunk, so its list is as long as there are chunks at most. Dealt once, it needs no join to go back.
    grams = materialize(seen.where("key >= 0").select("chunk", "key", "n").repartition("key").groupBy("key").agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks")), "grams")
    of_words = seen.where("key < 0").select("chunk", "key", "n").repartition("key").groupBy("key").agg(F.sum("n").alias("n"), F.collect_list("chunk").alias("chunks"))
    words = materialize(of_words, "words")
    texts = materialize(seen.where("key IS NULL").select(F.col("chunk").alias("part"), "n", "texts"), "texts")
    discard(seen)
    of_runs = costs(grams, depth, head).select("chunk", "gaps", "values", F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("value"))
    apart = words.select("key", F.col("n").cast("double").alias("value"), F.explode("chunks").alias("chunk"))
    # Empty lists, not null ones: Arrow's writer goes over all nulls before each null list of a batch.
    none = lambda kind: F.array().cast(f"array<{kind}>")
    entries = of_runs.unionByName(apart.select("chunk", none("long").alias("gaps"), none("double").alias("values"), "key", "value"))
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n_train = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, kinds = sums["n"] + n_train, sums["v"] + (n_train > 0)
    floor = math.log10(total + kinds + 1)
    schema = "doc_id long, trains boolean, n_tokens long, n_known long, train_tokens long, n_bytes long, base_score double, score double"

    def chunk_scores(texts: pa.Table, model: pa.Table) -> pa.Table:
        of_words = model.filter(pc.is_valid(model.column("key")))
        counts = dict(zip(of_words.column("key").to_pylist(), of_words.column("value").to_pylist()))
        of_runs = model.filter(pc.is_null(model.column("key")))
        found = [np.zeros(0, np.int64), *(turn_back(np.cumsum(x.values.to_numpy()), depth, head) for x in of_runs.column("gaps"))]
        run_keys, run_values = np.concatenate(found), pc.list_flatten(of_runs.column("values")).to_numpy()
        order = np.argsort(run_keys)
        run_keys, run_values = run_keys[order], run_values[order]
        del found
        never = math.log10(1) - floor

        class Logs(dict):
            def __missing__(self, word: bytes) -> float:
                log = self[word] = math.log10(counts[word_key(word)] + 1) - floor
                return log

        log_of = Logs().__getitem__
        out = {name.split()[0]: [] for name in schema.split(", ")}
        for batch in unpacked(texts):
            for part in steps(iter([batch]), "text", SCORED_BYTES):
                raws = [raw_of(t) for t in part.column("text").to_pylist()]
                # Looked up in order, neighbours lie near each other; that takes less than half the time, sorting included.
                own = runs(raws, depth)
                order, along = np.argsort(own), np.zeros(len(own) + 1)
                along[order + 1] = run_values[np.searchsorted(run_keys, own[order])]
                np.cumsum(along, out=along)
                ends = np.cumsum([0, *(len(r) + 1 for r in raws)])
                out["score"] += (along[ends[1:]] - along[ends[:-1]]).tolist()
                for raw in raws:
                    words = words_of(raw)
                    logs = list(map(log_of, words))
                    known = int(n_train > 0) + len(logs) - logs.count(never)
                    base = sum(logs, math.log10(n_train + 1) - floor)
                    out["n_tokens"].append(len(words) + 1)
                    out["n_known"].append(known)
                    out["base_score"].append(base)
                    out["n_bytes"].append(len(raw))
                out["doc_id"] += part.column("doc_id").to_pylist()
                out["trains"] += part.column("trains").to_pylist()
        out["train_tokens"] = [total] * len(out["doc_id"])
        fields = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        return pa.table({f.split()[0]: pa.array(out[f.split()[0]], fields[f.split()[1]]) for f in schema.split(", ")})

    return texts.groupBy("part").cogroup(entries.groupBy("chunk")).applyInArrow(chunk_scores, schema)
