"""Evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates_by_class(rows: DataFrame, label: str, hit: str) -> DataFrame:
    """Counts and hit rate by class and overall (class null), null where nothing was counted."""
    sets = rows.groupingSets([[F.col(label)], []], F.col(label))
    counted = F.count(F.col(hit))
    return sets.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(hit)).alias("hits"), (F.count_if(F.col(hit)) / F.nullif(counted, F.lit(0))).alias("rate"))


def sample_metrics(rows: DataFrame, group: str, label: str, probability: str, order: str) -> DataFrame:
    """Accuracy at one half, log loss, and the share of groups whose most probable row is labelled."""
    p = F.greatest(F.least(F.col(probability), F.lit(1 - 1e-9)), F.lit(1e-9))
    loss = -(F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p)))
    per = rows.groupBy(group).agg(F.max_by(label, F.struct(F.col(probability), F.col(order))).alias("_top"), F.sum(((F.col(probability) >= 0.5).cast("int") == F.col(label)).cast("int")).alias("_right"), F.sum(loss).alias("_loss"), F.count(F.lit(1)).alias("_n"))
    return per.agg((F.sum("_right") / F.sum("_n")).alias("accuracy"), (F.sum("_loss") / F.sum("_n")).alias("log_loss"), F.avg(F.col("_top").cast("double")).alias("group_top1"))


def timing_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, least, most, mean, nearest-rank median and 95th percentile."""
    at = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), at(0.5).alias("median"), at(0.95).alias("p95"))


def compared_policies(rows: DataFrame, case: str, policy: str, metric: str, first: str, second: str) -> DataFrame:
    """Sums of a metric under two policies and their difference, by case."""
    wide = rows.groupBy(case).pivot(policy, [first, second]).agg(F.sum(metric))
    a, b = F.coalesce(first, F.lit(0.0)), F.coalesce(second, F.lit(0.0))
    return wide.select(case, a.alias("first"), b.alias("second"), (a - b).alias("delta"))


def highlights(outcomes: DataFrame, case: str, field: str) -> DataFrame:
    """Cases with a missing or wrong field, and those fields, from rows with ``outcome``."""
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("outcome") == kind, F.col(field))))
    told = outcomes.groupBy(case).agg(listed("missing").alias("missing"), listed("wrong").alias("wrong"))
    return told.where((F.size("missing") > 0) | (F.size("wrong") > 0))
