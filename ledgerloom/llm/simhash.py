"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits both lie within one bit of some
third value. So every distinct fingerprint emits itself and its 64 one-bit
variants, variants are shuffled, and fingerprints that meet on one are linked.
Copies are collapsed first and a variant has at most 65 fingerprints around it,
so no group of a shuffle grows with the number of copies.

Null or empty texts have the fingerprint zero and are linked like any other. Rows
with a null id get their fingerprint, no component, and link nothing. Rows of the
same id are one node. Repeated rows are returned each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, map_steps, materialize, salted_join
from .components import connected_components

#: Shingles that are hashed at a time, so that a very long text needs no more memory.
CHUNK = 100_000


def shingle_hashes(words: list[bytes], shingle: int, seed: int = 42):
    """XXH64 of each run of ``shingle`` words joined by spaces (of all, if fewer), in bounded arrays."""
    from xxhash import xxh64_intdigest as digest

    n = len(words)
    if n <= shingle:
        if n:
            yield np.array([digest(b" ".join(words), seed)], np.uint64)
        return
    for at in range(0, n - shingle + 1, CHUNK):
        part = words[at : at + CHUNK + shingle - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = [0, *(ends[: len(part) - shingle] + 1).tolist()]
        yield np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def fingerprint(words: list[bytes], shingle: int) -> int:
    """64 bits; a bit is 1 if it is set in over half of the shingles' hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(words, shingle):
        for at in range(0, len(h), 4096):  # sums of bytes in the cache
            bits = np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(0, dtype=np.uint16)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint)``, a 64-bit integer, for each row of ``docs(doc_id, text)``."""

    def step(batch: pa.RecordBatch):
        texts = batch.column("text").to_pylist()
        found = np.array([fingerprint(words_of(t), shingle) for t in texts], np.uint64)
        yield {"doc_id": batch.column("doc_id"), "fingerprint": pa.array(found.view(np.int64))}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_steps(rows, step, "doc_id long, fingerprint long")


def ball(column: Column, bits: int = 64) -> Column:
    """The value and all that differ from it in one of the low ``bits``."""
    return F.concat(F.array(column), F.array(*[column.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(bits)]))


def meetings(nodes: DataFrame, bits: int = 64) -> DataFrame:
    """``(variant, node, least, n)``: for each variant that several of ``nodes(node, fingerprint)`` emit, those nodes, the
    least of them and their number. One row for each node and variant at most, so rows grow with the nodes alone."""
    at = Window.partitionBy("variant")
    emitted = nodes.select("node", F.explode(ball(F.col("fingerprint"), bits)).alias("variant"))
    return emitted.select("variant", "node", F.min("node").over(at).alias("least"), F.count(F.lit(1)).over(at).alias("n")).where("n > 1")


def links(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``(a, b)`` that join all ``nodes(node, fingerprint)`` within ``radius`` (at most 2) bits of each other.

    Fingerprints are distinct. Nodes that meet on a variant are within two bits pairwise and are linked to its least
    node when ``radius`` is 2, so the links span the same components as all pairs, with no more rows than meetings.
    """
    if radius != 2:
        raise ValueError("variants within one bit give a radius of 2")
    pairs = materialize(meetings(nodes).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "met")
    a, b = (nodes.select(F.col("node").alias(x), F.col("fingerprint").alias(f"f{x}")) for x in "ab")
    checked = salted_join(pairs, a, "a", "b").hint("merge").join(b.hint("merge"), "b")
    return checked.where(F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius).select("a", "b")


def near_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row; links are fingerprints at 2 or fewer differing bits."""
    base = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(base.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("node")), "nodes")
    repeated = base.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fingerprint").alias("x"), F.max("fingerprint").alias("y")).where("x <> y")
    # An id with several texts joins their fingerprints' nodes.
    ties = base.hint("merge").join(repeated.select("doc_id").hint("merge"), "doc_id").hint("merge").join(nodes.hint("merge"), "fingerprint").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = connected_components(links(nodes).union(ties))
    of = nodes.hint("merge").join(found.hint("merge"), nodes.node == found.node, "left").select("fingerprint", F.coalesce("component", nodes.node).alias("component_id"))
    out = base.hint("merge").join(of.hint("merge"), "fingerprint", "left")
    return out.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


#: Fingerprints of :func:`without_near_copies`: ``BLOCKS`` of ``WIDTH`` bits each, from the set of a text's words.
BLOCKS, WIDTH = 6, 24
_LANES = -(-BLOCKS * WIDTH // 64)
_ORDERS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(BLOCKS)], np.uint64)


def block_prints(words: list[bytes], shingle: int) -> list[tuple[int, int]]:
    """For each block its ``WIDTH`` bits, and the least hash of the text's word runs in an order of the block's own.

    A bit is 1 if set in over half of the distinct words' hashes. Empty without words.
    """
    if not words:
        return []
    hashes = np.unique(np.concatenate([*shingle_hashes(words, 1)]))
    ones = np.zeros(64 * _LANES, np.int64)
    for at in range(0, len(hashes), 4096):
        wide = [hashes[at : at + 4096]]
        for _ in range(_LANES - 1):
            x = (wide[-1] ^ (wide[-1] >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
            wide.append(x ^ (x >> np.uint64(32)))
        bits = np.unpackbits(np.stack(wide, 1).view(np.uint8).reshape(-1, 8 * _LANES), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.uint16)
    whole = int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")
    least = np.full(BLOCKS, np.iinfo(np.uint64).max, np.uint64)
    for runs in shingle_hashes(words, shingle):
        for k in range(BLOCKS):
            x = (runs ^ (runs >> np.uint64(31))) * _ORDERS[k]
            least[k] = min(least[k], (x ^ (x >> np.uint64(29))).min())
    return [(whole >> (k * WIDTH) & ((1 << WIDTH) - 1), int(m)) for k, m in enumerate(least.view(np.int64))]


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``(node, shingles)``: the sorted distinct 64-bit hashes of the word runs of ``texts(node, text)``."""

    def step(batch: pa.RecordBatch):
        own = [np.concatenate([*shingle_hashes(words_of(t), shingle), np.zeros(0, np.uint64)]) for t in batch.column("text").to_pylist()]
        yield {"node": batch.column("node"), "shingles": [np.unique(h.view(np.int64)) for h in own]}

    return map_steps(texts, step, "node long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(a, b)`` whose ``sets(node, shingles)`` have a Jaccard similarity of ``similarity`` or more."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = salted_join(pairs.hint("merge").join(b.hint("merge"), "b"), a, "a", "b")
    least, most = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    both = both.where((least > 0) & (least >= F.lit(similarity) * most))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= F.lit(similarity) * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def meeting_texts(prints: DataFrame) -> DataFrame:
    """``(variant, block, node, least, last)``: for each variant that several of ``prints(node, prints)`` emit, those nodes
    with the first and the last of them. A variant's key holds the block and its least run as well.

    Variants of a block that the same nodes emit are one: equal prints share all of theirs, so that without this a group
    of them would stand in the table once for each variant. Sets are told by count, ends and combined hashes of 64 bits.
    """
    near = lambda p, k: F.transform(ball(p.bits, WIDTH), lambda v: F.struct(k.alias("block"), F.xxhash64(v, p.least, k).alias("variant")))
    emitted = prints.select("node", F.explode(F.flatten(F.transform("prints", near))).alias("_x")).select("node", "_x.*")
    at = Window.partitionBy("variant")
    ends = {"least": F.min("node").over(at), "last": F.max("node").over(at), "_n": F.count(F.lit(1)).over(at), "_all": F.bit_xor(F.xxhash64("node")).over(at)}
    met = emitted.select("block", "node", *[c.alias(n) for n, c in ends.items()]).where("least < last")
    return met.select(F.xxhash64("block", "_n", "_all", "least", "last").alias("variant"), "block", "node", "least", "last").distinct()


def first_pairs(met: DataFrame) -> DataFrame:
    """``(a, b)``, a below b: each node of :func:`meeting_texts` with the first and the last that it meets in each block."""
    ends = met.groupBy("node", "block").agg(F.min("least").alias("least"), F.max("last").alias("last"))
    both = F.filter(F.array("least", "last"), lambda x: x != F.col("node"))
    return ends.select("node", F.explode(both).alias("_x")).select(F.least("node", "_x").alias("a"), F.greatest("node", "_x").alias("b")).distinct()


def further_pairs(met: DataFrame, alike: DataFrame, groups: DataFrame, tried: DataFrame, turn: int) -> DataFrame:
    """Pairs not ``tried`` yet between texts that met but are in different ``groups(node, component)``.

    In each variant's group that is not one component, all are paired with the text that has most links ``alike``, through
    which a star's texts are joined, and with one by an order of the variant's and the turn's own. Rows grow with ``met``.
    """
    ends = alike.select(F.col("a").alias("node")).union(alike.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    told = groups.hint("merge").join(ends.hint("merge"), "node", "left")
    rows = met.select("variant", "node").hint("merge").join(told.hint("merge"), "node", "left")
    rows = rows.select("variant", "node", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    order = F.xxhash64("node", "variant", F.lit(turn))
    one = F.struct("node", "component")
    reps = rows.groupBy("variant").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min_by(one, F.struct(-F.col("links"), order)).alias("hub"), F.min_by(one, order).alias("other"),
    ).where("low < high").select("variant", F.array("hub", "other").alias("_reps"))
    met_reps = salted_join(rows, reps, "variant", "node").select("node", "component", F.explode("_reps").alias("_r")).where(F.col("component") != F.col("_r.component"))
    pairs = met_reps.select(F.least("node", "_r.node").alias("a"), F.greatest("node", "_r.node").alias("b")).distinct()
    return pairs.hint("merge").join(tried.hint("merge"), ["a", "b"], "left_anti")


def remaining_pairs(met: DataFrame, groups: DataFrame, tried: DataFrame, size: int = 1024, salts: int = 32) -> DataFrame:
    """All pairs not ``tried`` yet between texts that met on a variant and are in different ``groups(node, component)``.

    Only variants' groups that are not one component are paired; those above ``size`` texts are dealt over up to
    ``salts`` tasks, and a merge join holds no more than one key's rows, which it spills.
    """
    told = met.select("variant", "node").hint("merge").join(groups.hint("merge"), "node", "left")
    rows = told.select("variant", "node", F.coalesce("component", "node").alias("component"))
    mixed = rows.groupBy("variant").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high")
    shares = mixed.select("variant", F.least(F.ceil(F.col("n") / size), F.lit(salts)).cast("int").alias("_shares"))
    rows = salted_join(rows, shares, "variant", "node")
    one = rows.select("variant", F.pmod(F.xxhash64("node"), F.col("_shares")).cast("int").alias("_salt"), F.col("node").alias("a"), F.col("component").alias("_a"))
    other = rows.select("variant", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_salt"), F.col("node").alias("b"), F.col("component").alias("_b"))
    both = one.hint("merge").join(other.hint("merge"), ["variant", "_salt"]).where("a < b AND _a <> _b")
    return both.select("a", "b").distinct().hint("merge").join(tried.hint("merge"), ["a", "b"], "left_anti")


def without_near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` less near-duplicates: of each group of linked texts the scan's first row stays.

    Texts link at a Jaccard similarity of their sets of ``shingle``-word runs (A-Z in lower case) of ``similarity`` or
    more. Candidates agree in one of ``BLOCKS`` blocks: up to two of ``WIDTH`` bits of a SimHash of their words, found by
    ball hashing, and the least of their runs in the block's own order, which two texts share as often as they are
    similar and which keeps unlike texts of the same words apart. At 0.8 over 99 % of single pairs meet, more above. In
    each block a text is first compared with the first and the last of all that it meets there. Groups of texts that met
    but did not become one component go on in rounds, each text with the one of most links and with another of each
    variant's group, until a round finds no link any more; so pairs grow with the texts in each round. Then all pairs
    that met, are still in different groups and were not drawn are compared, so that every pair that met is settled; in
    large groups of texts that are unlike each other these grow with the square. Each pair is verified on its whole
    sets; what chains of similar pairs join is one group.

    Texts of fewer than ``shingle`` words are one run. Equal texts are one group, empty and null ones together; a text
    of white space alone has no runs and is like its equals only. Null ids are rows like others, repeated rows are
    copies, ties go to the scan's first row; very long texts are hashed in steps; an empty table gives an empty result.
    All columns are kept, whatever their names; the input's scan must number its rows alike each time, as stored
    tables do.
    """

    def prints(batch: pa.RecordBatch):
        found = [[{"bits": b, "least": m} for b, m in block_prints(words_of(t), shingle)] for t in batch.column("text").to_pylist()]
        yield {c: batch.column(c) for c in ("row", "x", "y")} | {"prints": found}

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = fresh(docs, "_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    given = numbered.select(F.col(row).alias("row"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"), text.alias("text"))
    rows = materialize(map_steps(given, prints, "row long, x long, y long, prints array<struct<bits:bigint,least:bigint>>"), "prints")
    nodes = materialize(rows.groupBy("x", "y").agg(F.min("row").alias("node"), F.min("prints").alias("prints")), "texts")
    met = materialize(meeting_texts(nodes.select("node", "prints")), "met")
    tried = materialize(first_pairs(met), "pairs")
    wanted = met.select(F.col("node").alias("row")).distinct()
    needed = given.select("row", "text").hint("merge").join(wanted.hint("merge"), "row").select(F.col("row").alias("node"), "text")
    sets = materialize(shingle_sets(needed, shingle), "sets")
    alike = materialize(similar(tried, sets, similarity), "similar")
    groups, turn = connected_components(alike), 0
    while True:
        turn += 1
        more = materialize(further_pairs(met, alike, groups, tried, turn), "pairs")
        if more.isEmpty():
            discard(more)
            break
        new = materialize(similar(more, sets, similarity), "similar")
        done = new.isEmpty()
        held = tried, alike, groups, more, new
        tried, alike = materialize(tried.union(more), "pairs"), materialize(alike.union(new), "similar")
        groups = connected_components(alike)
        discard(*held)
        # A round of hubs follows the first round's links at least.
        if done and turn > 1:
            break
    rest = materialize(remaining_pairs(met, groups, tried), "pairs")
    if not rest.isEmpty():
        new = materialize(similar(rest, sets, similarity), "similar")
        held = alike, groups
        alike = materialize(alike.union(new), "similar")
        groups = connected_components(alike)
        discard(*held, new)
    discard(rest)
    discard(met, sets, alike, tried)
    first = nodes.select("node", "x", "y").hint("merge").join(groups.withColumnRenamed("node", "_node").hint("merge"), F.col("node") == F.col("_node"), "left")
    firsts = first.select(F.struct("x", "y").alias("xy"), F.coalesce("component", "node").alias("first"))
    gone = salted_join(rows.select("row", F.struct("x", "y").alias("xy")), firsts, "xy", "row").where("row <> first")
    gone = materialize(gone.select(F.col("row").alias(row)), "gone")
    discard(rows, nodes, groups)
    return numbered.hint("merge").join(gone.hint("merge"), row, "left_anti").drop(row)
