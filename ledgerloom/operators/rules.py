"""Validation rules of invoices in two sets (V7): ten for invoices, two for all documents.

Invoices are rows with ``invoice_number, invoice_date, original_invoice_date, seller_gstin, buyer_gstin,
grand_total_words`` (text), ``line_items`` (an array of ``LINE`` structs) and ``footer`` (a ``FOOTER`` struct), amounts in
cents, rates in hundredths of a percent. All conditions are expressions on a document's own row, so validation shuffles
nothing. A rule whose values are null does not fail, but for required fields.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import number_words

LINE = "quantity_thousandths bigint, rate_cents bigint, gross_cents bigint, discount_cents bigint, taxable_cents bigint, cgst_bp bigint, sgst_bp bigint, cgst_cents bigint, sgst_cents bigint, igst_cents bigint"
FOOTER = "total_taxable_cents bigint, total_cgst_cents bigint, total_sgst_cents bigint, total_igst_cents bigint, total_cess_cents bigint, other_charges_cents bigint, round_off_cents bigint, grand_total_cents bigint"
# The form of a GSTIN with its state codes (01-38, 97, 99), and the tolerances in cents and hundredths of a percent.
GSTIN_FORM = "^(?:0[1-9]|[12][0-9]|3[0-8]|97|99)[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$"
DATE_FORM = "^[0-9]{1,4}[/.-]"
NEAR_LINE, NEAR_RATE, NEAR_FOOTER, NEAR_WORDS, MOST_ROUND_OFF = 100, 1, 200, 100, 100


def _money(cents: Column) -> Column:
    return F.format_string("%.2f", cents / 100.0)


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("long"))


def _failure(fails: Column, group: str, rule: str, severity: str, at: Column | str, message: Column) -> Column:
    """One failure, or null where the condition is not true."""
    told = F.struct(F.lit(group).alias("rule_set"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (F.lit(at) if isinstance(at, str) else at).alias("field"), message.alias("message"))
    return F.when(fails, told)


def _apart(a: Column, b: Column, near: int) -> Column:
    return F.abs(a - b) > near


def _of_lines(rule: str, part: str, fails, message) -> Column:
    """Failures of a rule about single lines, in the order of the lines."""
    def one(x: Column, i: Column) -> Column:
        at = F.concat(F.lit("line_items["), i.cast("string"), F.lit("]" + (f".{part}" if part else "")))
        return _failure(fails(x), "invoice", rule, "error", at, F.concat(F.lit("Line "), (i + 1).cast("string"), F.lit(": "), message(x)))

    return F.transform(F.coalesce("line_items", F.array().cast(f"array<struct<{LINE.replace(' ', ':').replace(',:', ',')}>>")), one)


def invoice_failures() -> Column:
    """The ten rules of invoices: an array of ``(rule_set, rule, severity, field, message)`` in the order of the rules."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else _money(p) for p in parts])
    foot = lambda name: F.col(f"footer.{name}_cents")
    up = lambda c: F.upper(F.trim(c))
    summed = lambda name: F.aggregate("line_items", F.lit(0).cast("long"), lambda a, x: a + _zero(x[name]))
    product = lambda x: F.floor(x.quantity_thousandths * x.rate_cents / 1000.0 + 0.5).cast("long")
    net = lambda x: x.gross_cents - _zero(x.discount_cents)
    grand = foot("total_taxable") + sum((_zero(foot(n)) for n in ("total_cgst", "total_sgst", "total_igst", "total_cess", "other_charges", "round_off")), F.lit(0).cast("long"))
    worded = number_words(F.col("grand_total_words"))
    read = (worded > 0) | F.lower("grand_total_words").rlike("\\bzero\\b")
    gstins = F.array(*[
        _failure(~up(F.col(f)).rlike(GSTIN_FORM), "invoice", "gstin_checksum", "error", f, F.concat(F.lit(f"{f} is not a GSTIN: "), F.col(f))) for f in ("seller_gstin", "buyer_gstin")
    ])
    lines = [
        _of_lines("line_arithmetic", "gross_cents", lambda x: _apart(product(x), x.gross_cents, NEAR_LINE), lambda x: text("quantity by rate is ", product(x), ", the gross amount ", x.gross_cents)),
        _of_lines("line_taxable_value", "taxable_cents", lambda x: _apart(net(x), x.taxable_cents, NEAR_LINE), lambda x: text("gross less discount is ", net(x), ", the taxable value ", x.taxable_cents)),
        _of_lines("cgst_equals_sgst", "", lambda x: _apart(x.cgst_bp, x.sgst_bp, NEAR_RATE), lambda x: text("the CGST rate is ", x.cgst_bp, " %, the SGST rate ", x.sgst_bp, " %")),
        _of_lines("cgst_igst_exclusion", "", lambda x: (x.cgst_cents > 0) & (x.igst_cents > 0), lambda x: text("both CGST ", x.cgst_cents, " and IGST ", x.igst_cents)),
    ]
    footers = [_failure((F.size("line_items") > 0) & _apart(summed("taxable_cents"), foot("total_taxable"), NEAR_FOOTER), "invoice", "footer_taxable_total", "error", "footer.total_taxable_cents", text("taxable values of lines sum to ", summed("taxable_cents"), ", the footer has ", foot("total_taxable")))]
    footers += [
        _failure((F.size("line_items") > 0) & _apart(summed(f"{t}_cents"), foot(f"total_{t}"), NEAR_FOOTER), "invoice", "footer_tax_totals", "error", f"footer.total_{t}_cents", text(f"{t.upper()} of lines sums to ", summed(f"{t}_cents"), ", the footer has ", foot(f"total_{t}")))
        for t in ("cgst", "sgst", "igst")
    ]
    footers += [
        _failure(_apart(grand, foot("grand_total"), NEAR_FOOTER), "invoice", "grand_total_check", "error", "footer.grand_total_cents", text("the parts sum to ", grand, ", the grand total is ", foot("grand_total"))),
        _failure(read & _apart(worded, foot("grand_total"), NEAR_WORDS), "invoice", "words_vs_figures", "warning", "grand_total_words", text("the words say ", worded, ", the figures ", foot("grand_total"))),
        _failure(F.abs(foot("round_off")) > MOST_ROUND_OFF, "invoice", "round_off_check", "warning", "footer.round_off_cents", text("the round-off is ", foot("round_off"))),
    ]
    return F.filter(F.concat(gstins, *lines, F.array(*footers)), lambda f: f.isNotNull())


def common_failures() -> Column:
    """The two rules of all documents, like :func:`invoice_failures`; a blank value is a missing one."""
    blank = lambda f: F.coalesce(F.trim(f) == "", F.lit(True))
    required = [_failure(blank(f), "common", "required_fields", "error", f, F.lit(f"{f} is missing")) for f in ("invoice_number", "invoice_date")]
    dates = [_failure(~blank(f) & ~F.trim(f).rlike(DATE_FORM), "common", "date_format", "error", f, F.concat(F.lit(f"{f} is not a date: "), F.col(f))) for f in ("invoice_date", "original_invoice_date")]
    return F.filter(F.array(*required, *dates), lambda f: f.isNotNull())
