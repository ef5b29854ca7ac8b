"""Verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .items import strict_amounts, summary, tax_sum
from .stepped import per_document, read


def computation_trace(lines: DataFrame) -> DataFrame:
    """V2: three steps for each order line and three closing steps, with index and running subtotal.

    ``lines`` are those of :func:`ledgerloom.operators.render.order_lines`.
    """
    running = Window.partitionBy("l_orderkey").orderBy("position")
    summed = lines.withColumn("_sum", F.sum("line_cents").over(running)).withColumn("_last", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    bp = F.when(F.col("l_orderkey") % 4 == 0, 0).when(F.col("l_orderkey") % 4 == 1, 500).when(F.col("l_orderkey") % 4 == 2, 1200).otherwise(1800)
    summed = summed.withColumn("_tax", F.expr("1").cast("long") * F.floor((F.col("_sum") * bp + 5000) / 10000).cast("long"))
    before = F.col("_sum") - F.col("line_cents")
    step = lambda i, name, value, total: F.struct(i.cast("long").alias("trace_index"), F.lit(name).alias("step"), value.cast("long").alias("value"), total.cast("long").alias("subtotal"))
    at = (F.col("position") - 1) * 3
    each = F.array(step(at, "read_item", F.col("qty"), before), step(at + 1, "multiply", F.col("line_cents"), before), step(at + 2, "add", F.col("line_cents"), F.col("_sum")))
    end = F.col("position") * 3
    close = F.array(step(end, "emit_subtotal", F.col("_sum"), F.col("_sum")), step(end + 1, "emit_tax", F.col("_tax"), F.col("_sum")), step(end + 2, "emit_total", F.col("_sum") + F.col("_tax"), F.col("_sum")))
    return summed.select("l_orderkey", F.explode(F.when(F.col("position") == F.col("_last"), F.concat(each, close)).otherwise(each)).alias("s")).select("l_orderkey", "s.*")


def single_rate(rates: DataFrame, key: str, rate: str) -> DataFrame:
    """V3: the one rate of each group, null with the count where several differ."""
    found = rates.groupBy(key).agg(F.count_distinct(F.round(rate, 6)).alias("n_rates"), F.max(rate).alias("_rate"))
    return found.select(key, "n_rates", F.when(F.col("n_rates") == 1, F.col("_rate")).alias("rate"))


def unit_price(printed: Column, inclusive: Column, amount: Column, quantity: Column, rate_bp: Column) -> Column:
    """V4: printed price, else the inclusive one without tax, else amount over quantity, in cents."""
    net = F.floor(inclusive * 10000 / (10000 + rate_bp) + 0.5).cast("long")
    return F.coalesce(printed, net, F.floor(amount / quantity + 0.5).cast("long"))


#: V7: rules as (name, severity, condition that must hold), on ``n_lines, subtotal, tax, total, order_total``.
RULES = [
    ("has_lines", "error", "n_lines > 0"),
    ("positive_total", "error", "total > 0"),
    ("total_adds_up", "error", "abs(subtotal + tax - total) <= 100"),
    ("matches_order", "warning", "abs(total - order_total) <= 100"),
    ("few_lines", "warning", "n_lines <= 8"),
]


def failures(rows: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """V7: array of ``(rule, severity)`` of the rules that do not hold; an unknown condition does not fail."""
    return F.filter(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"), F.coalesce(~F.expr(c), F.lit(False)).alias("fails")) for n, s, c in rules]), lambda x: x.fails)


def status(failed: Column) -> tuple[Column, Column]:
    """V9: FAIL, WARN or PASS, and 1 less 0.15 for each error and 0.05 for each warning, not below 0."""
    errors = F.size(F.filter(failed, lambda x: x.severity == "error"))
    warnings = F.size(F.filter(failed, lambda x: x.severity == "warning"))
    score = F.greatest(F.lit(0), 100 - 15 * errors - 5 * warnings) / 100
    return F.when(errors > 0, "FAIL").when(warnings > 0, "WARN").otherwise("PASS"), score


def party_match(names: DataFrame, ledger: DataFrame) -> DataFrame:
    """V8: ledger entries whose name equals a name in upper case; ``names(name)``, ``ledger(key, ledger_name)``."""
    left = names.select("name", F.upper(F.trim("name")).alias("_u"))
    right = ledger.select("key", F.upper(F.trim("ledger_name")).alias("_u"))
    return left.join(right, "_u", "left").select("name", "key")


def unprocessed(docs: DataFrame, seen: DataFrame, version: str, days: int = 30) -> DataFrame:
    """Documents without an entry of their content hash and version within ``days``; one of each content.

    ``seen(content_hash, version, age_days)`` is the record of earlier runs.
    """
    hashed = docs.withColumn("content_hash", F.sha2(F.col("text"), 256))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    fresh = seen.where((F.col("version") == version) & (F.col("age_days") <= days)).select("content_hash")
    return first.hint("merge").join(fresh.hint("merge"), "content_hash", "left_anti")


def compared(actual: DataFrame, expected: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Outer comparison of long tables field by field: match, wrong, missing or extra."""
    a = actual.select(*keys, F.col(value).alias("actual"), F.lit(True).alias("_a"))
    e = expected.select(*keys, F.col(value).alias("expected"), F.lit(True).alias("_e"))
    told = F.when(F.col("_e").isNull(), "extra").when(F.col("_a").isNull(), "missing").when(F.col("actual").eqNullSafe(F.col("expected")), "match").otherwise("wrong")
    return a.hint("merge").join(e.hint("merge"), keys, "full").withColumn("outcome", told).drop("_a", "_e")


def _both(*flags: bool | None) -> bool | None:
    """AND as SQL has it."""
    return False if any(f is False for f in flags) else None if any(f is None for f in flags) else True


def _receipt(raw: bytes | None, tolerance: int) -> Iterator[tuple]:
    lines, shapes = read(raw)
    rows = strict_amounts(lines, shapes)
    if rows:
        last, taxes = summary(lines, shapes)
        fits = [abs(math.floor(q * p / 1000.0 + 0.5) - a) <= tolerance for q, p, a in rows if None not in (q, p, a)]
        sums = [a for _, _, a in rows if a is not None]
        near = lambda a, b: None if a is None or b is None else abs(a - b) <= tolerance
        total, taxed = (sum(sums), sum(sums) + (tax_sum(taxes) or 0)) if sums else (None, None)
        checks = all(fits) if fits else None, near(last.get("taxable"), total), near(taxed, last.get("total"))
        yield (*checks, _both(*checks))


def receipt_checks(docs: DataFrame, tolerance: int = 100) -> DataFrame:
    """V5: for documents with strict items, whether lines, the taxable amount and the total agree, in cents.

    A document is checked in its own row; ``doc_id`` is the key.
    """
    return per_document(docs, lambda raw: _receipt(raw, tolerance), "lines_agree boolean, taxable_agrees boolean, total_agrees boolean, verified boolean")


def hints(failed: Column) -> Column:
    """The failed rules as a line to go with a text for another attempt."""
    return F.when(F.size(failed) > 0, F.concat(F.lit("Hints: "), F.array_join(F.transform(failed, lambda x: x.rule), "; "))).otherwise("")
