"""Prefix trie of conversations by ROLLUP over positional turn-id columns.

A turn's id is a hash of its role and text with the text's length. A conversation's turns are cut into blocks of
``WIDTH`` positions, one column each, and a block's key stands for all turns before it: the depth, and two running 64-bit
sums (by exclusive or) over the hashes of the blocks before. Copies collapse, and one ``ROLLUP`` over the columns within
each key gives all nodes of all blocks together; ``grouping_id`` tells a node's depth. A second ``ROLLUP``, over the nodes,
gives the sums over subtrees within a block; what hangs below a block's end is added first, by doubling the distance
between a block and its forebear, so the rounds grow with the logarithm of the longest conversation.

Nothing is gathered by conversation or node: positions come from counts of ranges of rows, sums are aggregated before
each shuffle, joins on a parent are dealt over salts, and the hash of a node's members reads sorted pieces in a stream.

Null roles and texts are empty. Rows with a null ``conv_id`` take no part. Rows of one turn are ordered by role and text,
repeated rows stay, and null turns come first. Texts of any length count whole. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, importable, materialize, salted_join

#: Turn columns of a block, and blocks of a conversation that one window reads.
WIDTH, SEGMENT = 8, 1024
#: Members in one piece of the list that is hashed.
PIECE = 4096

TURNS = [f"t{j}" for j in range(1, WIDTH + 1)]
KEY = ["depth", "k1", "k2"]


def _lane(lane: int, *columns: Column) -> Column:
    return F.xxhash64(F.lit(f"lane{lane}"), *columns)


def node_id(depth: Column, k1: Column, k2: Column) -> Column:
    return F.concat_ws(":", depth, F.hex(k1), F.hex(k2))


#: The root's id, as :func:`node_id` gives it.
ROOT = "0:0:0"


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn_id)`` with positions from 1; a long conversation is numbered by many tasks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    length = F.unhex(F.lpad(F.hex(F.length("text")), 8, "0"))
    turn_id = F.concat(F.substring(F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)), 1, 16), length)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select("conv_id", turn_id.alias("turn_id"), F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("place"))
    dealt = materialize(dealt, "ranges")
    within, before = Window.partitionBy("conv_id", "range"), Window.partitionBy("conv_id").orderBy("range")
    counts = dealt.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("conv_id", "range", (F.sum("n").over(before) - F.col("n")).alias("offset"))
    numbered = dealt.withColumn("own", F.row_number().over(within.orderBy("place")))
    found = numbered.hint("merge").join(offsets.hint("merge"), ["conv_id", "range"])
    out = materialize(found.select("conv_id", (F.col("own") + F.col("offset")).alias("pos"), "turn_id"), "turns")
    discard(dealt)
    return out


def rebuilt(found: DataFrame, family: int = 100, share: int = 6) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, pos, turn_id)`` of the rebuilt conversations, and ``(conv_id)`` of all.

    Conversation c gets the first h turns of conversation c - c % ``family`` in place of its own first h, where h is the
    CRC-32 of c's decimal text % ``share``.
    """
    heads = found.where((F.col("conv_id") % family == 0) & (F.col("pos") < share)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id"))).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % share
    all_ids = found.select("conv_id").distinct().withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    given = all_ids.hint("merge").join(heads.select(F.col("conv_id").alias("base"), "head").hint("merge"), "base", "left")
    taken = F.coalesce(F.filter("head", lambda x: x.pos <= F.col("h")), F.array().cast("array<struct<pos:bigint,turn_id:binary>>"))
    given = materialize(given.select("conv_id", "h", taken.alias("head"), F.size(taken).alias("n_head")), "heads")
    first = given.select("conv_id", F.explode("head").alias("_x")).select("conv_id", "_x.pos", "_x.turn_id")
    rest = salted_join(found, given.select("conv_id", "h", "n_head"), "conv_id", "pos").where("pos > h")
    return first.unionByName(rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "turn_id")), given


def blocks(rows: DataFrame) -> DataFrame:
    """``(conv_id, depth, k1, k2, t1.., last)``: a conversation's turns in columns, under the key of what comes before.

    ``depth`` is the depth of the key's node; ``last`` tells the conversation's last block.
    """
    at = ((F.col("pos") - 1) / WIDTH).cast("long")
    columns = [F.max(F.when((F.col("pos") - 1) % WIDTH == j, F.col("turn_id"))).alias(t) for j, t in enumerate(TURNS)]
    wide = rows.groupBy("conv_id", at.alias("block")).agg(*columns).withColumn("segment", (F.col("block") / SEGMENT).cast("long"))
    hashed = materialize(wide.select("*", *[_lane(i, "block", *TURNS).alias(f"x{i}") for i in (1, 2)]), "blocks")
    # Sums over the segments before, then over the blocks before in the segment.
    totals = hashed.groupBy("conv_id", "segment").agg(F.bit_xor("x1").alias("s1"), F.bit_xor("x2").alias("s2"), F.max("block").alias("end"))
    ahead = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = totals.select("conv_id", "segment", *[F.coalesce(F.bit_xor(f"s{i}").over(ahead), zero).alias(f"o{i}") for i in (1, 2)], F.max("end").over(Window.partitionBy("conv_id")).alias("end"))
    own = Window.partitionBy("conv_id", "segment").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    running = hashed.select("conv_id", "segment", "block", *TURNS, *[F.coalesce(F.bit_xor(f"x{i}").over(own), zero).alias(f"x{i}") for i in (1, 2)])
    joined = running.hint("merge").join(offsets.hint("merge"), ["conv_id", "segment"])
    return joined.select(
        "conv_id", (F.col("block") * WIDTH).alias("depth"), F.col("x1").bitwiseXOR(F.col("o1")).alias("k1"), F.col("x2").bitwiseXOR(F.col("o2")).alias("k2"), *TURNS,
        (F.col("block") == F.col("end")).alias("last"),
    )


def _id_at(j: int) -> Column:
    """The id of the node at the block's column ``j``; at the last column it is the next block's key."""
    if j == 0:
        return node_id(F.col("depth"), F.col("k1"), F.col("k2"))
    block = (F.col("depth") / WIDTH).cast("long")
    own = [c if i < j else F.lit(None).cast("binary") for i, c in enumerate(map(F.col, TURNS))]
    return node_id(F.col("depth") + j, *[F.col(f"k{i}").bitwiseXOR(_lane(i, block, *own)) for i in (1, 2)])


def _by_level(level: Column, value) -> Column:
    out = F.when(level == 1, value(1))
    for j in range(2, WIDTH + 1):
        out = out.when(level == j, value(j))
    return out


def _rolled(rows: DataFrame, aggregates: str) -> DataFrame:
    """``rows`` aggregated at every prefix of the turn columns within each key, with its column number as ``level``."""
    turn_list = ", ".join(TURNS)
    rolled = rows.sparkSession.sql(
        f"SELECT depth, k1, k2, {turn_list}, grouping_id() AS _g, {aggregates} FROM {{rows}} GROUP BY depth, k1, k2, ROLLUP ({turn_list})", rows=rows
    )
    level = F.lit(0)
    for j in range(1, WIDTH + 1):
        level = F.when(F.col("_g") == (1 << (WIDTH - j)) - 1, j).otherwise(level)
    leveled = rolled.withColumn("level", level).drop("_g")
    # A group whose own column is null holds what ended before it; level 0 is the block before.
    return leveled.where((F.col("level") > 0) & _by_level(F.col("level"), lambda j: F.col(f"t{j}").isNotNull()))


def _ends(rows: DataFrame) -> DataFrame:
    """``(id, ends_sha256)`` of ``rows(id, conv_id)``: the hash of each node's members in order, read as a stream."""
    spark = rows.sparkSession

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([held[0]], pa.int64()), pa.array([",".join(map(str, held))])], ["id", "first", "members"])

        for batch in batches:
            for n, c in zip(batch.column("id").to_pylist(), batch.column("conv_id").to_pylist()):
                if held and (n != node or len(held) == PIECE):
                    yield out()
                    held = []
                node = n
                held.append(c)
        if held:
            yield out()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

        for batch in batches:
            for n, members in zip(batch.column("id").to_pylist(), batch.column("members").to_pylist()):
                if n != node:
                    if state:
                        yield out()
                    node, state = n, hashlib.sha256(members.encode())
                else:
                    state.update(b"," + members.encode())
        if state:
            yield out()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = rows.repartitionByRange(parts, "id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(pieces, "id string, first bigint, members string")
    return listed.repartition("id").sortWithinPartitions("id", "first").mapInArrow(hashes, "id string, ends_sha256 string")


def _below(nodes: DataFrame) -> DataFrame | None:
    """``(id, leaves, saved)``: sums over the whole subtree below each node that has a further block."""
    sums = nodes.where("depth > 0").groupBy(node_id(F.col("depth"), F.col("k1"), F.col("k2")).alias("id")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    up = F.when(F.col("depth") > 0, node_id(F.col("depth"), F.col("k1"), F.col("k2")))
    ends = nodes.where(F.col("level") == WIDTH).select("id", up.alias("up"))
    now = materialize(sums.hint("merge").join(ends.hint("merge"), "id"), "below")
    while not now.where("up IS NOT NULL").isEmpty():
        # Sums reach twice as far: each block's to the forebear at the present distance.
        given = now.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        grown = now.hint("merge").join(given.hint("merge"), "id", "left").select(
            "id", "up", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")
        )
        higher = now.select(F.col("id").alias("up"), F.col("up").alias("higher"))
        moved = salted_join(grown.where("up IS NOT NULL"), higher, "up", "id").select("id", F.col("higher").alias("up"), "leaves", "saved")
        new = materialize(moved.unionByName(grown.where("up IS NULL").select("id", "up", "leaves", "saved")), "below")
        discard(now)
        now = new
    return now


def prefix_trie(conversations: DataFrame, family: int = 100, share: int = 6) -> DataFrame:
    """One row for each node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    spark = conversations.sparkSession
    importable(spark)
    found = turns(conversations)
    rows, every = rebuilt(found, family, share)
    parts = materialize(blocks(rows), "keyed")
    copies = parts.groupBy(*KEY, *TURNS).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    nodes = _rolled(copies, "min(conv_id) AS conv_id, sum(n) AS n_convs")
    turn_id = _by_level(F.col("level"), lambda j: F.col(f"t{j}"))
    nodes = nodes.withColumn("id", _by_level(F.col("level"), _id_at)).withColumn("parent", _by_level(F.col("level"), lambda j: _id_at(j - 1)))
    nodes = materialize(nodes.withColumn("chars", F.conv(F.hex(F.substring(turn_id, 17, 4)), 16, 10).cast("long")), "nodes")
    children = nodes.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    counted = nodes.hint("merge").join(children.hint("merge"), "id", "left").select("*", F.when(F.col("n_children").isNull(), 1).otherwise(0).alias("leaf"), saved)
    counted = materialize(counted.withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "counted")
    below = _below(counted)
    with_below = counted.hint("merge").join(below.select("id", F.col("leaves").alias("_l"), F.col("saved").alias("_s")).hint("merge"), "id", "left")
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0).cast("long"))).alias(a)
    sums = _rolled(with_below.select(*KEY, *TURNS, add("leaf", "_l"), add("saved", "_s")), "sum(leaf) AS n_leaves, sum(saved) AS saved_tokens")
    sums = sums.select(_by_level(F.col("level"), _id_at).alias("id"), "n_leaves", "saved_tokens")

    # The root: all conversations, and the sums over all nodes.
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = F.when(F.col("parent") == F.lit(ROOT), 1).otherwise(0).cast("long")
    parts_of_root = every.select("conv_id", F.lit(1).cast("long").alias("n"), zero.alias("children"), zero.alias("leaves"), zero.alias("saved")).unionByName(
        counted.select(none.alias("conv_id"), zero.alias("n"), top.alias("children"), F.col("leaf").cast("long").alias("leaves"), "saved")
    )
    root = parts_of_root.agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]).where("n > 0").select(
        F.lit(ROOT).alias("id"), F.lit(None).cast("string").alias("parent"), "conv_id", zero.alias("depth"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.greatest("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    )
    others = counted.select("id", "parent", "conv_id", (F.col("depth") + F.col("level")).cast("long").alias("depth"), "n_convs", "n_children")
    whole = materialize(others.hint("merge").join(sums.hint("merge"), "id").select(root.columns).unionByName(root), "whole")

    width = sum((F.col(t).isNotNull().cast("int") for t in TURNS), F.lit(0))
    at_end = parts.where("last").withColumn("level", width).select(_by_level(F.col("level"), _id_at).alias("id"), "conv_id")
    turnless = every.select("conv_id").hint("merge").join(parts.where("last").select("conv_id").hint("merge"), "conv_id", "left_anti").select(F.lit(ROOT).alias("id"), "conv_id")
    ended = _ends(materialize(at_end.unionByName(turnless), "ends"))
    above = whole.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    told = salted_join(whole.where("parent IS NOT NULL"), above, "parent", "id").unionByName(whole.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")))
    out = told.hint("merge").join(ended.hint("merge"), "id", "left")
    discard(found, counted, below, nodes)
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    )
