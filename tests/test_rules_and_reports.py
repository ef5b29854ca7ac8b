"""The rules of invoices one by one, and the report of a receipt as text."""

import pytest

from ledgerloom.operators import report, rules
from pyspark.sql import functions as F

INVOICE = f"invoice_number string, invoice_date string, original_invoice_date string, seller_gstin string, buyer_gstin string, grand_total_words string, line_items array<struct<{rules.LINE.replace(' ', ':').replace(',:', ',')}>>, footer struct<{rules.FOOTER.replace(' ', ':').replace(',:', ',')}>"
LINE = {"quantity_thousandths": 2000, "rate_cents": 5000, "gross_cents": 10000, "discount_cents": None, "taxable_cents": 10000, "cgst_bp": 900, "sgst_bp": 900, "cgst_cents": 900, "sgst_cents": 900, "igst_cents": None}
FOOTER = {"total_taxable_cents": 10000, "total_cgst_cents": 900, "total_sgst_cents": 900, "total_igst_cents": 0, "total_cess_cents": None, "other_charges_cents": None, "round_off_cents": 0, "grand_total_cents": 11800}
CLEAN = {"invoice_number": "A1", "invoice_date": "01/02/2024", "original_invoice_date": None, "seller_gstin": "27AABCU9603R1ZM", "buyer_gstin": " 27aabcu9603r1zm ", "grand_total_words": "one hundred eighteen rupees only", "line_items": [LINE], "footer": FOOTER}
NOTHING = dict.fromkeys(CLEAN)
CASES = [
    (CLEAN, []),
    (NOTHING, [("required_fields", "invoice_number"), ("required_fields", "invoice_date")]),
    (CLEAN | {"line_items": [], "footer": None}, []),
    (CLEAN | {"seller_gstin": "39AABCU9603R1ZM", "buyer_gstin": "27AABCU9603R1XM"}, [("gstin_checksum", "seller_gstin"), ("gstin_checksum", "buyer_gstin")]),
    (CLEAN | {"line_items": [LINE | {"gross_cents": 10100}]}, []),
    (CLEAN | {"line_items": [LINE | {"gross_cents": 10101, "discount_cents": 101}]}, [("line_arithmetic", "line_items[0].gross_cents")]),
    (CLEAN | {"line_items": [LINE, LINE | {"quantity_thousandths": None, "taxable_cents": 0, "cgst_cents": 0, "sgst_cents": None}]}, [("line_taxable_value", "line_items[1].taxable_cents")]),
    (CLEAN | {"line_items": [LINE | {"sgst_bp": 450}]}, [("cgst_equals_sgst", "line_items[0]")]),
    (CLEAN | {"line_items": [LINE | {"igst_cents": 200}]}, [("cgst_igst_exclusion", "line_items[0]")]),
    (CLEAN | {"line_items": [LINE | {"igst_cents": 201}]}, [("cgst_igst_exclusion", "line_items[0]"), ("footer_tax_totals", "footer.total_igst_cents")]),
    (CLEAN | {"footer": FOOTER | {"total_taxable_cents": 10201, "grand_total_cents": 12001}, "grand_total_words": "unreadable"}, [("footer_taxable_total", "footer.total_taxable_cents")]),
    (CLEAN | {"footer": FOOTER | {"grand_total_cents": 12001}}, [("grand_total_check", "footer.grand_total_cents"), ("words_vs_figures", "grand_total_words")]),
    (CLEAN | {"footer": FOOTER | {"round_off_cents": -101, "grand_total_cents": 11700}}, [("round_off_check", "footer.round_off_cents")]),
    (CLEAN | {"invoice_date": "soon", "original_invoice_date": "2024-01-02"}, [("date_format", "invoice_date")]),
    (CLEAN | {"invoice_number": " ", "original_invoice_date": "12345/1"}, [("required_fields", "invoice_number"), ("date_format", "original_invoice_date")]),
]


def test_each_rule(spark):
    names = [c.split()[0] for c in INVOICE.split(", ")[:6]] + ["line_items", "footer"]
    rows = spark.createDataFrame([(i, *[case[n] for n in names]) for i, (case, _) in enumerate(CASES)], f"i int, {INVOICE}")
    found = rows.select("i", F.concat(rules.invoice_failures(), rules.common_failures()).alias("f")).collect()
    got = {r["i"]: [(f["rule"], f["field"]) for f in r["f"]] for r in found}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    told = {r["i"]: r["f"] for r in found}
    assert told[5][0]["message"] == "Line 1: quantity by rate is 100.00, the gross amount 101.01" and told[12][0]["severity"] == "warning" and told[12][0]["rule_set"] == "invoice"


RECEIPT = """PROFORMA INVOICE
Sold to
Trader 5 Pvt Ltd  PI No: PI-7  Date : 03/04/2024
GST No. 27AABCU9603R1ZM
PAYMENT TERM:- 100% Advance
SR.  PRODUCT DESCRIPTION  QTY  UNIT  AMOUNT RS.
1  Steel rod  2.5  1,00,000.00  2,50,000.00
2  Nut  3  0.10  0.31
TAXABLE  2,50,000.30
GST @ 5%  12,500.02
Rs. Amount in words only  TOTAL  2,62,500.32
Firm 9 LLP
GST No. 24AABCU9603R1ZX
"""
WANT = """FAIL | receipt | PI-7
Date: 03/04/2024
Seller: Firm 9 LLP (24AABCU9603R1ZX)
Buyer: Trader 5 Pvt Ltd (27AABCU9603R1ZM)
Items:
  #1 Steel rod | qty 2.5 | net Rs. 1,00,000.00 | line Rs. 2,50,000.00
  #2 Nut | qty 3 | net Rs. 0.10 | line Rs. 0.31
Computed totals: taxable Rs. 2,50,000.30 + tax Rs. 12,500.02 = total Rs. 2,62,500.32.
Declared totals: taxable Rs. 2,50,000.30 + tax Rs. 12,500.02 = total Rs. 2,62,500.32.
Checks:
  PASS Invoice number | expected present | actual PI-7
  PASS Seller name | expected present | actual Firm 9 LLP
  PASS Buyer name | expected present | actual Trader 5 Pvt Ltd
  PASS Seller GSTIN | expected present | actual 24AABCU9603R1ZX
  PASS Buyer GSTIN | expected present | actual 27AABCU9603R1ZM
  PASS Line 1 amount | expected Rs. 2,50,000.00 | actual Rs. 2,50,000.00
  FAIL Line 2 amount | expected Rs. 0.30 | actual Rs. 0.31
  PASS Taxable amount | expected Rs. 2,50,000.30 | actual Rs. 2,50,000.30
  PASS Tax amount | expected Rs. 12,500.02 | actual Rs. 12,500.02
  PASS Total amount | expected Rs. 2,62,500.32 | actual Rs. 2,62,500.32"""
DETAILED = "TAX INVOICE\n1  Pipe  7308  5%  2  pcs  105.00  100.00  pcs  200.00\nIGST  10.00\nTotal  2 pcs  ₹ 210.00"


def test_reports(spark):
    texts = [RECEIPT, None, "", "Dear all", DETAILED, RECEIPT.replace("GST @ 5%", "GST @ 5%  0.01\nGST @ 12%"), DETAILED.replace("210.00", "211.00")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, checks string")
    rows = report.verified(docs).withColumn("told", report.as_text()).withColumn("issues", report.issues(F.col("checks"))).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    assert rows[0]["told"] == WANT and rows[0]["issues"] == ["Line 2 amount: expected Rs. 0.30, actual Rs. 0.31"]
    assert [r["told"] for r in rows[1:4]] == [f"ERROR | {report.NO_ITEMS}"] * 3 and {r["ok"] for r in rows[1:4]} == {None}
    assert rows[5]["error"] == report.MANY_RATES and rows[5]["checks"] is None
    labels = {c["label"]: c["pass"] for c in rows[4]["checks"]}
    assert labels["Inclusive rate cross-check"] and labels["Tax amount"] and labels["Total amount"] and not labels["Invoice number"]
    assert "gross Rs. 105.00" in rows[4]["told"] and "Seller: missing" in rows[4]["told"]
    assert not {c["label"]: c["pass"] for c in rows[6]["checks"]}["Inclusive rate cross-check"]
    assert report.verified(docs.limit(0)).collect() == []
