"""State replay of traces (D6): the state before each event, however long a trace is.

A trace is cut into blocks. What a block changes is reduced to one row for each key before any shuffle of whole traces,
so the state at a block's start needs no pass over the events before it, and no task holds more of a trace than a block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replayed(events: DataFrame, keys: int = 81, block: int = 256) -> DataFrame:
    """``events(entity_id, trace_index, op, key, value, focus)`` with the state before each of them.

    ``place`` sets ``key`` (0 to ``keys`` - 1) to ``value``, ``backtrack`` sets it back to 0, ``focus`` replaces the focus
    by its struct; any other op changes nothing, as does a key that is null or out of range. A placed null counts as 0.
    Adds ``state`` (``keys`` values, 0 where unset), ``filled`` (values that are not 0) and ``focus_before`` (null before
    the first one). ``trace_index`` orders an entity's events and is unique there. Further columns stay.
    """
    at_focus = F.col("op") == "focus"
    sets = F.col("op").isin("place", "backtrack") & F.col("key").between(0, keys - 1)
    target = F.when(at_focus, -1).when(sets, F.col("key")).cast("int")
    new = F.when(F.col("op") == "place", F.coalesce(F.col("value"), F.lit(0))).otherwise(0).cast("int")
    told = events.withColumns({"_block": F.floor(F.col("trace_index") / block).cast("long"), "_key": target, "_new": F.struct(new.alias("value"), F.when(at_focus, F.col("focus")).alias("focus"))})
    changes = told.where("_key IS NOT NULL").groupBy("entity_id", "_block", "_key").agg(F.max_by("_new", "trace_index").alias("_new"))
    last = told.groupBy("entity_id").agg(F.max("_block").alias("_last"))
    following = F.lead("_block").over(Window.partitionBy("entity_id", "_key").orderBy("_block"))
    held = changes.withColumn("_until", following).hint("merge").join(last.hint("merge"), "entity_id").withColumn("_until", F.coalesce("_until", "_last"))
    # A value holds from the block after its own up to the block that changes it again.
    held = held.where("_until > _block").select("entity_id", F.explode(F.sequence(F.col("_block") + 1, "_until")).alias("_block"), F.struct(F.col("_key").alias("key"), F.col("_new").alias("new")).alias("_held"))
    starts = held.groupBy("entity_id", "_block").agg(F.map_from_entries(F.collect_list("_held")).alias("_start"))
    rows = told.hint("merge").join(starts.hint("merge"), ["entity_id", "_block"], "left")
    before = Window.partitionBy("entity_id", "_block").orderBy("trace_index").rowsBetween(Window.unboundedPreceding, -1)
    here = lambda k: F.last(F.when(F.col("_key") == k, F.col("_new")), ignorenulls=True).over(before)
    held_before = lambda k: F.coalesce(here(k), F.try_element_at("_start", F.lit(k)))
    rows = rows.withColumns({"state": F.array(*[F.coalesce(held_before(k)["value"], F.lit(0)) for k in range(keys)]), "focus_before": held_before(-1)["focus"]})
    return rows.withColumn("filled", F.size(F.filter("state", lambda v: v != 0))).drop("_block", "_key", "_new", "_start")
