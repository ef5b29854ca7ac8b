"""Whole plans: receipt totals (R2, X2) and verified receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.candidates import receipt_totals
from ledgerloom.operators.families import classified
from ledgerloom.operators.verify import receipt_checks


def receipts(docs: DataFrame) -> DataFrame:
    """``(doc_id, family, total_cents, verified)`` of every document; a null total or check has no base in the text."""
    totals = receipt_totals(docs).select("doc_id", "total_cents")
    checks = receipt_checks(docs).select("doc_id", "verified")
    return classified(docs).select("doc_id", "family").hint("merge").join(totals.hint("merge"), "doc_id", "left").hint("merge").join(checks.hint("merge"), "doc_id", "left").withColumn("status", F.when(F.col("verified"), "PASS").when(F.col("verified").isNull(), "UNCHECKED").otherwise("FAIL"))
