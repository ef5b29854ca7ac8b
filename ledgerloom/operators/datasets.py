"""Training sets (D5-D18): samples, splits, vocabularies, encodings, weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.staged import staged
from ledgerloom.functions.text import fnv1a


def trace_events(events: DataFrame) -> DataFrame:
    """Event traces: index and coded step of each user's events in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kinds = ["click", "error", "purchase", "signup", "view"]
    code = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")).cast("int")
    return events.select(F.col("user_id").alias("entity_id"), (F.row_number().over(order) - 1).alias("trace_index"), "event_id", "event_type", code.alias("step"), "value")


def histories(traces: DataFrame, width: int = 8) -> DataFrame:
    """Each event with the ``width`` steps before it, padded with 0 at the left."""
    before = Window.partitionBy("entity_id").orderBy("trace_index").rowsBetween(-width, -1)
    steps = F.collect_list("step").over(before)
    return traces.withColumn("_steps", steps).withColumn("history", F.concat(F.array_repeat(F.lit(0), F.lit(width) - F.size("_steps")), F.col("_steps"))).drop("_steps")


def framed(traces: DataFrame, opens: Column, places: Column) -> DataFrame:
    """Placing events with the last opened value at their depth; after a mismatch an entity has no more samples."""
    t = traces.withColumn("depth", F.col("trace_index") % 4).withColumn("_open", F.when(opens, F.col("step")))
    at = Window.partitionBy("entity_id", "depth").orderBy("trace_index").rowsBetween(Window.unboundedPreceding, -1)
    samples = t.withColumn("frame", F.last("_open", ignorenulls=True).over(at)).where(places)
    so_far = Window.partitionBy("entity_id").orderBy("trace_index")
    bad = F.max(F.col("frame").isNull().cast("int")).over(so_far)
    return samples.withColumn("_bad", bad).where("_bad = 0").select("entity_id", "trace_index", "depth", "frame", "step")


def evenly(rows: DataFrame, entity: str, order: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of each entity at positions floor(i * n / limit)."""
    w = Window.partitionBy(entity)
    r, n = F.col("_r"), F.col("_n")
    told = rows.withColumn("_r", (F.row_number().over(w.orderBy(order)) - 1).cast("long")).withColumn("_n", F.count(F.lit(1)).over(w))
    i = F.expr(f"(_r * {limit} + _n - 1) div _n")
    return told.where((n <= limit) | ((i < limit) & (F.expr(f"(({'(_r * %d + _n - 1) div _n' % limit}) * _n) div {limit}") == r))).drop("_r", "_n")


def hash_split(key: Column, percent: int) -> Column:
    """Eval or train by FNV-1a of the entity's key."""
    return F.when(fnv1a(key) % 100 < percent, "eval").otherwise("train")


def hash_at(hashes: DataFrame, ratio: float, digits: int = 3, most: int = 1000) -> str:
    """The hash that max(1, floor(n * ratio)) of the n distinct hexadecimal hashes ``_h`` do not exceed, empty without any.

    Hashes are counted by their next ``digits`` until the bucket that holds the wanted one has at most ``most``; only
    those are fetched, and at most 16 ** ``digits`` counts at a time.
    """
    prefix, rank = "", None
    while True:
        within = hashes.where(F.col("_h").startswith(prefix))
        counts = within.groupBy(F.substring("_h", len(prefix) + 1, digits).alias("_next")).agg(F.count(F.lit(1)).alias("_n")).collect()
        if not counts:
            return ""
        if rank is None:
            rank = max(1, int(sum(r["_n"] for r in counts) * ratio))
        for bucket, size in sorted((r["_next"], r["_n"]) for r in counts):
            if rank <= size:
                break
            rank -= size
        prefix += bucket
        if size <= most:
            return sorted(r["_h"] for r in hashes.where(F.col("_h").startswith(prefix)).collect())[rank - 1]


def group_split(rows: DataFrame, group: str, ratio: float, seed: int = 7) -> DataFrame:
    """Exactly max(1, floor(n * ratio)) groups go to eval, in order of a hash of seed and group.

    The last hash of eval is found by counts of hash prefixes: no task ranks or holds all groups. Rows without a group
    are left out.
    """
    groups = rows.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(group).cast("string"))))
    edge = hash_at(groups.select("_h"), ratio)
    told = groups.withColumn("split", F.when(F.col("_h") <= edge, "eval").otherwise("train"))
    return rows.hint("merge").join(told.select(group, "split").hint("merge"), group)


SPECIAL = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"]


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """Special tokens, then distinct tokens in binary order, numbered.

    Tokens are ranked within blocks of their first two bytes and the blocks' offsets added, so that no one task
    holds all of them.
    """
    tokens = docs.select(F.explode(F.split(F.lower(text), "\\s+")).alias("token")).where("token <> ''").distinct()
    tokens = tokens.withColumn("_block", F.hex(F.substring(F.encode("token", "UTF-8"), 1, 2)))
    sizes = tokens.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    # At most 65,792 blocks.
    offsets = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_block")) - F.col("_n"))
    ranked = tokens.withColumn("_r", F.row_number().over(Window.partitionBy("_block").orderBy(F.hex(F.encode("token", "UTF-8")))))
    numbered = ranked.join(F.broadcast(offsets), "_block").select("token", (F.col("_before") + F.col("_r") + len(SPECIAL) - 1).cast("long").alias("id"))
    special = docs.sparkSession.createDataFrame(list(zip(SPECIAL, range(len(SPECIAL)))), "token string, id long")
    return special.union(numbered)


def encoded(docs: DataFrame, key: list[str], text: str, vocab: DataFrame, length: int) -> DataFrame:
    """Ids of each text as CLS, tokens, SEP, padding, of ``length``, and the mask."""
    tokens = docs.select(*key, F.posexplode_outer(F.slice(F.filter(F.split(F.lower(text), "\\s+"), lambda t: t != ""), 1, length - 2)).alias("_at", "token"))
    ids = tokens.hint("merge").join(vocab.hint("merge"), "token", "left").withColumn("_id", F.when(F.col("token").isNotNull(), F.coalesce("id", F.lit(1))))
    kept = ids.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("_id").isNotNull(), F.struct("_at", "_id")))), lambda x: x["_id"]).alias("_ids"))
    full = F.concat(F.array(F.lit(2).cast("long")), F.col("_ids"), F.array(F.lit(3).cast("long")))
    return kept.withColumn("_full", full).select(
        *key, F.concat("_full", F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("_full"))).alias("ids"), F.size("_full").alias("n_used")
    )


def class_weights(rows: DataFrame, label: str, labels: list) -> DataFrame:
    """Total / (labels * count) of each listed label, 0 where it is absent."""
    given = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{label} int")
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    joined = given.join(counts, label, "left").join(F.broadcast(total))
    return joined.select(label, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, F.col("_total") / (len(labels) * F.col("n"))).otherwise(0.0).alias("weight"))


def oversampled(rows: DataFrame, repeats: Column) -> DataFrame:
    """Rows as often as ``repeats`` says, numbered from 1."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), repeats)))


def grids(orders: DataFrame) -> DataFrame:
    """Grids made from orders: a valid pattern, one cell broken where the key ends in 0."""
    k, cell = F.col("o_orderkey") % 9, F.sequence(F.lit(0), F.lit(80))

    def value(i: Column) -> Column:
        r, c = F.floor(i / 9), i % 9
        good = (3 * (r % 3) + F.floor(r / 3) + c + k) % 9 + 1
        return F.when((i == 0) & (F.col("o_orderkey") % 10 == 0), good % 9 + 1).otherwise(good).cast("int")

    blank = lambda i: (i + F.col("o_orderkey")) % 3 == 0
    # Grids are heavy for the few bytes of an order: a set number of partitions keeps them from a few tasks.
    parts = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return orders.select("o_orderkey").repartition(parts, "o_orderkey").select("o_orderkey", F.transform(cell, value).alias("answer"), F.transform(cell, lambda i: F.when(blank(i), 0).otherwise(value(i))).alias("question"))


def solved(answer: Column) -> Column:
    """Whether every row, column and box of 81 digits holds 1 to 9."""
    def units(place) -> Column:
        return F.forall(F.sequence(F.lit(0), F.lit(8)), lambda u: F.size(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda j: F.get(answer, place(u, j).cast("int"))))) == 9)

    digits = F.forall(answer, lambda x: (x >= 1) & (x <= 9)) & (F.size(answer) == 81)
    box = lambda u, j: (F.floor(u / 3) * 3 + F.floor(j / 3)) * 9 + (u % 3) * 3 + j % 3
    return digits & units(lambda u, j: u * 9 + j) & units(lambda u, j: j * 9 + u) & units(box)


def legal_values(grid: DataFrame) -> DataFrame:
    """For each open cell of ``grid(o_orderkey, question)`` the digits that no cell of its row, column or box has."""
    units = [[j for j in range(81) if unit(j) == u] for unit in (lambda j: j // 9, lambda j: j % 9, lambda j: j // 27 * 3 + j % 9 // 3) for u in range(9)]
    # The digits of each row, column and box are found once, as bits of a number; a cell reads the three of its own.
    powers = F.array(*[F.lit(1 << d if d else 0) for d in range(10)])
    bit = lambda j: F.coalesce(F.get(powers, F.get("question", F.lit(j))), F.lit(0))
    bits = staged(grid.select("o_orderkey", "question"), _bits=F.array(*[bit(j) for j in range(81)]))
    of = lambda cells: reduce(lambda x, y: x.bitwiseOR(y), (F.get("_bits", F.lit(j)) for j in cells))
    used = staged(bits, _used=F.array(*[of(cells) for cells in units])).select("o_orderkey", "_used", F.posexplode("question").alias("cell", "_v")).where("_v = 0")
    place = lambda e: F.get("_used", F.expr(e).cast("int"))
    met = place("cell div 9").bitwiseOR(place("9 + cell % 9")).bitwiseOR(place("18 + cell div 27 * 3 + cell % 9 div 3"))
    free = F.array_compact(F.array(*[F.when(F.col("_met").bitwiseAND(F.lit(1 << d)) == 0, F.lit(d)) for d in range(1, 10)]))
    return used.select("o_orderkey", "cell", met.alias("_met")).select("o_orderkey", "cell", free.alias("legal"))


def with_positive(rows: DataFrame, group: str, label: str) -> DataFrame:
    """Rows of groups in which some label is 1."""
    return rows.withColumn("_most", F.max(label).over(Window.partitionBy(group))).where("_most = 1").drop("_most")


def choice(seed: int, key: Column, draw: int, n: int) -> Column:
    """Draw number ``draw`` of a key among ``n``, the same in any partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), key, F.lit(draw)), F.lit(n)).cast("int")
