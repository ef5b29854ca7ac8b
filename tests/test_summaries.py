"""Summary amounts and checks read in a document's row, as expressions state them."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.numbers import money_to_cents
from ledgerloom.functions.staged import staged
from ledgerloom.functions.text import EDGE, collapse
from ledgerloom.operators import items, verify
from ledgerloom.operators.render import read_order_documents, read_voucher_documents
from ledgerloom.queries import QUERIES

from .golden import DOCS
from .test_amounts import ODD, same

MORE = [
    "1 Bolt 2 3.00 6.00\nTAXABLE 6.00\nGST @ 18% 1.08\nTOTAL 7.08", "1 Bolt 2.1234 3.00 6.00\nTotal 6.00", "1 Bolt , 3.00 6.00", " 2  a 995442 18 % 2.5 KW 1,888.00 1,600.00 KW ₹ 4,000.00\nmore\nIGST 720.00\nTotal 2.5 KW ₹ 4,720.00",
    "TCS -\nRound Off (+/-) -\nTCS 1.00 2.00\nSub Total 5.00\nsub total 6.00 7.00", "IGST 5% 1.00\nCGST 2.5 % Rs. 2.00\nSGST\nGST none\nTOTALS 4.00\nGrand  Total Rs 5.00", "TCS -\u2028", "1 x 2 3.00 6.50\n2 y 1 4.00 4.00\nTAXABLE 10.00 ",
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    odd = spark.createDataFrame([(f"odd{i}", t) for i, t in enumerate([*ODD, *MORE, *DOCS.values()])], "doc_id string, text string")
    first = F.col("doc_id").cast("long") < 200
    own = read_order_documents(spark, sf).where(first).select("doc_id", "text").unionByName(read_voucher_documents(spark, sf).where(first).select(F.concat(F.lit("v"), "doc_id").alias("doc_id"), "text"))
    worn = F.when(F.xxhash64("doc_id") % 5 == 0, F.regexp_replace("text", "TAXABLE  ", "TAXABLE  9")).otherwise(F.col("text"))
    return odd.unionByName(own.withColumn("text", worn)).where("text IS NULL OR text NOT LIKE '%9999999999%'").repartition(4).localCheckpoint()


def amounts_by_expressions(docs):
    """P11 as expressions."""
    starts = lambda x, words: x.rlike(f"(?i)^(?:{words}){EDGE}")

    def told(x):
        one, dash = x.n == 1, x.text.rlike("-$")
        kind = (
            F.when(starts(x.text, "TAXABLE") & one, "taxable").when(starts(x.text, "Sub Total") & one, "subtotal").when(x.text.rlike(f"(?i){EDGE}TOTAL{EDGE}") & one, "total")
            .when(starts(x.text, "TCS"), "tcs").when(starts(x.text, "Round Off"), "round_off").when(starts(x.text, "IGST|CGST|SGST|GST") & one, "tax")
        )
        return F.struct(x.text.alias("text"), kind.alias("kind"), F.when(kind.isin("tcs", "round_off") & dash, 0).otherwise(money_to_cents(x.last)).alias("cents"))

    tokens = lambda x: F.regexp_extract_all(x.text, F.lit(f"({items.MONEY})"))
    with_money = F.transform("_lines", lambda x: F.struct(x.text.alias("text"), F.size(tokens(x)).alias("n"), F.try_element_at(tokens(x), F.lit(-1)).alias("last")))
    rows = staged(items._lines(docs).where(F.exists("_lines", lambda x: x.text != "")), _lines=with_money)
    rows = staged(rows, _told=F.filter(F.transform("_lines", told), lambda x: x.kind.isNotNull()))
    last = lambda k: F.try_element_at(F.filter("_told", lambda x: x.kind == k), F.lit(-1))["cents"].alias(f"{k}_cents")
    taxes = F.transform(F.filter("_told", lambda x: x.kind == "tax"), lambda x: F.struct(
        collapse(F.regexp_replace(x.text, items.MONEY, "")).alias("label"), x.cents.alias("cents"), F.regexp_extract(x.text, "([0-9]+(?:\\.[0-9]+)?)\\s*%", 1).try_cast("double").alias("percent"),
    ))
    total = F.aggregate(taxes, F.lit(None).cast("long"), lambda a, x: F.coalesce(a, F.lit(0)) + x.cents)
    return rows.select("doc_id", *[last(k) for k in ("taxable", "subtotal", "total", "tcs", "round_off")], total.alias("tax_cents"), taxes.alias("tax_lines"))


def checks_by_expressions(docs, tolerance=100):
    """V5 over tables of items and amounts."""
    lines = items.strict_items(docs).withColumn("_ok", F.abs(F.floor(F.col("quantity_thousandths") * F.col("unit_price_cents") / 1000.0 + 0.5) - F.col("line_amount_cents")) <= tolerance)
    sums = lines.groupBy("doc_id").agg(F.bool_and("_ok").alias("lines_agree"), F.sum("line_amount_cents").alias("_sum"))
    told = sums.hint("merge").join(amounts_by_expressions(docs).hint("merge"), "doc_id").withColumn("taxable_agrees", F.abs(F.col("taxable_cents") - F.col("_sum")) <= tolerance)
    told = told.withColumn("total_agrees", F.abs(F.col("_sum") + F.coalesce("tax_cents", F.lit(0)) - F.col("total_cents")) <= tolerance)
    return told.select("doc_id", "lines_agree", "taxable_agrees", "total_agrees", (F.col("lines_agree") & F.col("taxable_agrees") & F.col("total_agrees")).alias("verified"))


def test_summary_amounts_are_those_of_the_expressions(docs):
    want = amounts_by_expressions(docs)
    same(items.summary_amounts(docs), want)
    same(items.summary_amounts(docs, with_lines=False), want.drop("tax_lines"))


def test_checks_are_those_of_the_tables(docs):
    same(verify.receipt_checks(docs), checks_by_expressions(docs))


@pytest.mark.parametrize("name", ["p11_summary_amounts", "v05_receipt_checks"])
def test_summaries_are_read_in_their_own_row(name, spark, sf):
    assert "MapInArrow" in QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
