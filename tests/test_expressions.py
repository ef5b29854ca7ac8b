"""Single expressions against literal values."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import numbers as num
from ledgerloom.functions import text as txt
from ledgerloom.operators import datasets, layout, mutate


def value(spark, expression, **columns):
    frame = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return frame.select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize("given, want", [("12.5", 1250), ("Rs. 1,23,456.07", 12345607), ("₹ 9", 900), ("1.234", None), ("x", None), ("", None)])
def test_money(spark, given, want):
    assert value(spark, num.money_to_cents(F.col("s")), s=given) == want


@pytest.mark.parametrize("given, want", [("2", 2000), ("1,234.5", 1234500), ("0.0625", None), ("2 pcs", None)])
def test_quantity(spark, given, want):
    assert value(spark, num.quantity_to_thousandths(F.col("s")), s=given) == want


@pytest.mark.parametrize("given, want", [(5, "0.05"), (12345, "123.45"), (1234567, "12,345.67"), (123456789, "12,34,567.89"), (12345678901, "12,34,56,789.01")])
def test_number_groups(spark, given, want):
    assert value(spark, num.format_number(F.col("n")), n=given) == want


@pytest.mark.parametrize("given, want", [
    ("24AAMFJ7876R1Z8", True), ("27AADCN3773B1ZM", True), ("24AAACZ1284C1ZN", True), ("24ABCDE1111F1Z3", False), ("24AAAAA2222G1Z4", False), ("short", False),
])
def test_gstin(spark, given, want):
    assert value(spark, num.gstin_valid(F.col("s")), s=given) is want


def test_fnv1a(spark):
    assert value(spark, txt.fnv1a(F.col("s")), s="abc") == 440920331


@pytest.mark.parametrize("given, want", [
    ("one lakh twenty three thousand four hundred fifty six", 12345600), ("Two Crore", 2000000000), ("nine hundred ninety nine", 99900), ("Rupees five thousand only", 500000), ("", 0),
    ("Rupees Fifty Thousand Four Hundred Forty Four and Paise Fifty Only", 5044450), ("INR Two Lakhs Thirty Five Thousand Six Hundred Only", 23560000),
    ("Rs. One Crore Twenty Lakhs", 1200000000), ("two lacs and fifty paise only", 20000050), ("Twenty-Three", 2300),
])
def test_number_words(spark, given, want):
    assert value(spark, num.number_words(F.col("s")), s=given) == want


@pytest.mark.parametrize("given, want", [("Grand Total ₹ 10.00", "currency money grand total"), ("  ", "none"), ("hello there", "text_only"), ("GST 2.500 Dr", "money qty_decimal dr gst")])
def test_context(spark, given, want):
    assert value(spark, txt.context_summary(F.col("s")), s=given) == want


def test_alpha_heavy(spark):
    assert value(spark, txt.alpha_heavy(F.col("s")), s="T0TAL 1NVOICE 12A 5ale5 B2B") == "TOTAL INVOICE 12A SaleS B2B"


def test_words_have_places(spark):
    assert [tuple(w) for w in value(spark, layout.words_of(F.col("s")), s="  a bc   d")] == [("a", 2, 3), ("bc", 4, 6), ("d", 9, 10)]


def test_statement_is_told(spark):
    lines = ["Account Statement", "x"]
    assert value(spark, layout.account_statement(F.array(*map(F.lit, lines)))) is True
    assert value(spark, layout.account_statement(F.array(F.lit("TAX INVOICE"), F.lit("bank statement")))) is False


def test_noise_changes_only_listed_letters(spark):
    text = "OISA oisa XYZ 012 " * 20
    got = value(spark, mutate.ocr_noise(F.col("s"), F.lit(3), 1), s=text)
    assert got != text and all(a == b or (a, b) in {("O", "0"), ("I", "1"), ("S", "5"), ("A", "4")} for a, b in zip(text, got))


def test_broken_grids_are_found(spark):
    orders = spark.range(30).withColumnRenamed("id", "o_orderkey")
    got = {r["o_orderkey"]: r["s"] for r in datasets.grids(orders).select("o_orderkey", datasets.solved(F.col("answer")).alias("s")).collect()}
    assert got == {i: i % 10 != 0 for i in range(30)}
