"""Ranking and choice within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; the order names a last key of its own."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def margins(rows: DataFrame, group: str, score: str, order: list[Column], stable: float = 6) -> DataFrame:
    """Lead of a group's first row over its second; null without a second; unstable below ``stable``."""
    w = Window.partitionBy(group).orderBy(F.desc(score), *order)
    led = rows.withColumn("_rank", F.row_number().over(w)).withColumn("margin", F.col(score) - F.lead(score).over(w)).where("_rank = 1")
    return led.drop("_rank").withColumn("unstable", F.coalesce(F.col("margin") < stable, F.lit(False)))


def blended(rows: DataFrame, model: str, rule: str) -> Column:
    """Model score plus a small share of the rule score."""
    return F.col(model) + F.least(F.col(rule) / 2400, F.lit(0.06))


def distinct_values(rows: DataFrame, group: str, value: str, order: list[Column], k: int) -> DataFrame:
    """Of each group's rows the first of each value, then the first ``k``."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group, value).orderBy(*order))).where("_n = 1").drop("_n")
    return top_k(first, group, order, k)


def softmax_top_k(rows: DataFrame, group: str, label: str, logit: str, k: int) -> DataFrame:
    """Softmax over each group's labels and its first ``k``."""
    w = Window.partitionBy(group)
    power = F.exp(F.col(logit) - F.max(logit).over(w))
    shares = rows.withColumn("_power", power).withColumn("probability", F.col("_power") / F.sum("_power").over(w)).drop("_power")
    return top_k(shares, group, [F.desc("probability"), F.col(label)], k)


# Lift over an even share and margin over the second that a greedy choice and the best two need.
GREEDY, BEAM = (0.18, 0.10), (0.06, 0.04)


def guidance(rows: DataFrame, group: str, value: str, score: str, width: int = 2) -> DataFrame:
    """A group's decision from its shares: greedy, the best ``width``, or fallback when neither stands out.

    Shares are scores over their sum, even where that is not above zero; a beam needs more values than its width.
    """
    w = Window.partitionBy(group)
    raw = F.greatest(F.col(score), F.lit(0.0))
    shares = rows.withColumn("_sum", F.sum(raw).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    shares = shares.withColumn("share", F.when(F.col("_sum") > 0, raw / F.col("_sum")).otherwise(1 / F.col("_n")))
    order = w.orderBy(F.desc("share"), value)
    led = shares.withColumn("_rank", F.row_number().over(order)).withColumn("_second", F.lead("share").over(order)).where("_rank = 1")
    lift, margin = F.col("share") - 1 / F.col("_n"), F.col("share") - F.coalesce("_second", F.lit(0.0))
    above = lambda limits: (lift >= limits[0]) & (margin >= limits[1])
    decision = F.when(above(GREEDY), "greedy").when(above(BEAM) & (F.col("_n") > width), "beam").otherwise("fallback")
    return led.select(group, F.col(value).alias("value"), "share", decision.alias("decision"))


def top_rows(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of all (TakeOrderedAndProject)."""
    return rows.orderBy(*order).limit(n)


def best(rows: DataFrame, group: str, value: str, score: str) -> DataFrame:
    """The value with the highest score of each group, the greater value on ties."""
    return rows.groupBy(group).agg(F.max(F.struct(score, value))[value].alias(value))


def agreement(rows: DataFrame, group: str, value: str, first: str, second: str) -> DataFrame:
    """Whether the highest of two scores fall on the same value of each group, smaller values first on ties."""
    top = lambda score: F.max_by(value, F.struct(F.col(score), -F.col(value)))
    return rows.groupBy(group).agg((top(first) == top(second)).alias("agree"))
