"""Verification of receipts check by check (V3, V5) and its report as text (V6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import format_number, format_quantity
from ledgerloom.functions.staged import staged

from .items import strict_items, summary_amounts
from .sections import receipt_heads
from .stored import stored
from .verify import unit_price

#: Why a receipt has no verification.
NO_ITEMS, MANY_RATES = "no line items found", "the receipt uses several tax rates"
#: Values that a receipt must show: label and column of the heads.
PRESENT = [("Invoice number", "number"), ("Seller name", "seller_name"), ("Buyer name", "buyer_name"), ("Seller GSTIN", "seller_gstin"), ("Buyer GSTIN", "buyer_gstin")]


def money(cents: Column) -> Column:
    """Rupees with a sign, ``missing`` for null."""
    return F.coalesce(F.concat(F.lit("Rs. "), F.when(cents < 0, "-").otherwise(""), format_number(F.abs(cents))), F.lit("missing"))


def inferred_rate(rates: Column, tax: Column, base: Column) -> Column:
    """V3: the one rate of an array of explicit ones, null where they differ by 1e-6; without any, tax over base to 4 decimals."""
    distinct = F.array_distinct(F.transform(F.filter(rates, lambda r: r.isNotNull()), lambda r: F.round(r, 6)))
    declared = F.when((tax > 0) & (base > 0), F.round(tax / base, 4)).otherwise(F.lit(0.0))
    return F.when(F.size(distinct) == 1, distinct[0]).when(F.size(distinct) == 0, declared)


def _check(kind: str, label: Column | str, passed: Column, expected: Column, actual: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), (F.lit(label) if isinstance(label, str) else label).alias("label"), passed.alias("pass"), expected.alias("expected"), actual.alias("actual"))


def _amounts(label: Column | str, expected: Column, actual: Column, when: Column | None = None) -> Column:
    """A check of two amounts, or null where it does not apply."""
    told = _check("arithmetic", label, F.coalesce(expected == actual, F.lit(False)), money(expected), money(actual))
    return told if when is None else F.when(when, told)


def verified(docs: DataFrame) -> DataFrame:
    """V5: each of ``docs(doc_id, text)`` with its checks in their order, once.

    Adds ``ok`` (all checks pass), ``error`` (why there is no verification: no items, or several rates; ``ok`` and
    ``checks`` are null then), ``rate``, ``checks(kind, label, pass, expected, actual)``, ``items``, the head's values and
    ``computed`` and ``declared`` amounts in cents. Five values must be there; lines, taxable amount, tax and total must
    agree to the cent where they are declared, and so must the sum of prices with tax where an item shows one. A null or
    empty text has no items. ``doc_id`` is the key.
    """
    own = stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    line = ["line_index", "item_index", "description", "unit", "quantity_thousandths", "unit_price_cents", "inclusive_cents", "line_amount_cents", "tax_rate"]
    items = strict_items(own, inclusive=True).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*line))).alias("_items"))
    rows = own.select("doc_id").hint("merge").join(items.hint("merge"), "doc_id", "left").hint("merge").join(summary_amounts(own).hint("merge"), "doc_id", "left").hint("merge").join(receipt_heads(own).hint("merge"), "doc_id", "left")
    total_of = lambda name, one: F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(one(x), F.lit(0).cast("long")))
    rates = F.concat(F.transform(F.coalesce("tax_lines", F.array()), lambda t: t.percent / 100), F.transform(F.coalesce("_items", F.array()), lambda x: x.tax_rate / 100))
    rows = staged(rows, _rates=rates)
    rows = staged(rows, rate=inferred_rate(F.col("_rates"), F.col("tax_cents"), F.coalesce("taxable_cents", total_of("_items", lambda x: x.line_amount_cents))))
    bp = F.round(F.col("rate") * 10000).cast("long")
    price = lambda x: unit_price(x.unit_price_cents, F.when(bp > 0, x.inclusive_cents), x.line_amount_cents * 1000, x.quantity_thousandths, bp)
    amount = lambda quantity, cents: F.floor(quantity * cents / 1000.0 + 0.5).cast("long")
    priced = F.transform("_items", lambda x: F.struct(x.alias("x"), price(x).alias("price"), amount(x.quantity_thousandths, price(x)).alias("amount")))
    rows = staged(rows, items=F.transform(priced, lambda y: F.struct(*[y.x[c].alias(c) for c in line if c != "line_index"], y.price.alias("price"), y.amount.alias("amount"))))
    rows = staged(rows, _sum=total_of("items", lambda x: x.amount), _gross=F.when(F.exists("items", lambda x: x.inclusive_cents.isNotNull()), total_of("items", lambda x: amount(x.quantity_thousandths, x.inclusive_cents))))
    rows = staged(rows, _tax=F.floor(F.col("_sum") * bp / 10000 + 0.5).cast("long"))
    present = [_check("metadata", label, F.coalesce(F.col(c) != "", F.lit(False)), F.lit("present"), F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("missing"))) for label, c in PRESENT]
    lines = F.transform(F.filter("items", lambda x: x.price.isNotNull() & x.line_amount_cents.isNotNull()), lambda x: _amounts(F.format_string("Line %d amount", x.item_index), x.amount, x.line_amount_cents))
    closing = F.array(
        _amounts("Taxable amount", F.col("_sum"), F.col("taxable_cents"), F.col("taxable_cents").isNotNull()), _amounts("Tax amount", F.col("_tax"), F.col("tax_cents"), F.size("tax_lines") > 0),
        _amounts("Total amount", F.col("_sum") + F.col("_tax"), F.col("total_cents"), F.col("total_cents").isNotNull()),
        _amounts("Inclusive rate cross-check", F.col("_gross"), F.col("total_cents"), F.col("_gross").isNotNull() & F.col("total_cents").isNotNull()),
    )
    error = F.when(F.col("items").isNull(), NO_ITEMS).when(F.col("rate").isNull(), MANY_RATES)
    rows = staged(rows, error=error, checks=F.when(error.isNull(), F.filter(F.concat(F.array(*present), lines, closing), lambda c: c.isNotNull())))
    amounts = lambda taxable, tax, total: F.struct(taxable.alias("taxable_cents"), tax.alias("tax_cents"), total.alias("total_cents"))
    return rows.select(
        "doc_id", F.forall("checks", lambda c: c["pass"]).alias("ok"), "error", "rate", "checks", "items", *receipt_heads(own).columns[1:],
        amounts(F.col("_sum"), F.col("_tax"), F.col("_sum") + F.col("_tax")).alias("computed"), amounts(F.col("taxable_cents"), F.col("tax_cents"), F.col("total_cents")).alias("declared"),
    )


def issues(checks: Column) -> Column:
    """V5: the failed checks as text, in their order."""
    return F.transform(F.filter(checks, lambda c: ~c["pass"]), lambda c: F.concat(c.label, F.lit(": expected "), c.expected, F.lit(", actual "), c.actual))


def as_text(kind: str = "receipt") -> Column:
    """V6: the report of a row of :func:`verified` as lines of text; that of an error is one line."""
    party = lambda p: F.concat(F.coalesce(f"{p}_name", F.lit("missing")), F.coalesce(F.concat(F.lit(" ("), F.col(f"{p}_gstin"), F.lit(")")), F.lit("")))
    title = F.concat_ws(" | ", F.when(F.col("ok"), "PASS").otherwise("FAIL"), F.lit(kind), "number")
    maybe = lambda c, text: F.when(c, text)
    item = lambda x: F.concat(F.lit("  "), F.concat_ws(
        " | ", F.format_string("#%d %s", x.item_index, x.description), F.concat_ws(" ", F.lit("qty"), format_quantity(x.quantity_thousandths), x.unit), F.concat(F.lit("net "), money(x.price)),
        F.when(x.inclusive_cents.isNotNull(), F.concat(F.lit("gross "), money(x.inclusive_cents))), F.concat(F.lit("line "), money(x.line_amount_cents)),
    ))
    sums = lambda name, c: F.concat(F.lit(f"{name} totals: taxable "), money(F.col(f"{c}.taxable_cents")), F.lit(" + tax "), money(F.col(f"{c}.tax_cents")), F.lit(" = total "), money(F.col(f"{c}.total_cents")), F.lit("."))
    check = lambda c: F.concat(F.when(c["pass"], "  PASS ").otherwise("  FAIL "), c.label, F.lit(" | expected "), c.expected, F.lit(" | actual "), c.actual)
    declared = F.coalesce("declared.taxable_cents", "declared.tax_cents", "declared.total_cents").isNotNull()
    other = F.col("consignee_name").isNotNull() & ~F.col("consignee_name").eqNullSafe(F.col("buyer_name"))
    lines = F.concat(
        F.array(title, maybe(F.col("date").isNotNull(), F.concat(F.lit("Date: "), F.col("date"))), F.concat(F.lit("Seller: "), party("seller")), F.concat(F.lit("Buyer: "), party("buyer")), maybe(other, F.concat(F.lit("Consignee: "), party("consignee"))), F.lit("Items:")),
        F.transform("items", item), F.array(sums("Computed", "computed"), maybe(declared, sums("Declared", "declared")), F.lit("Checks:")), F.transform("checks", check),
    )
    return F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR | "), F.col("error"))).otherwise(F.array_join(lines, "\n"))
